"""Example sentences of each exam file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions import text as X
from lexfreq.operators import trie as T


def candidates(files: DataFrame, text: str = "text", ends: str = V.SENTENCE_ENDS, script: str = V.HAN,
               glued: bool = True) -> DataFrame:
    """(file columns, pos, sentence): cleaned pieces that read as a sentence."""
    others = [c for c in files.columns if c != text]
    # Cleaned inside the array: behind an explode the filter would repeat the cleaning per condition.
    cleaned = F.transform(X.sentence_parts(F.col(text), ends), lambda p: X.strip_lead(p, script, glued))
    kept = F.filter(cleaned, lambda s: X.reads_as_sentence(s, script))
    return files.select(*others, F.posexplode(kept).alias("pos", "sentence"))


def per_file(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each sentence once per file, at its first position."""
    return found.groupBy(*keys, "sentence").agg(F.min("pos").alias("pos"))


def numbered(first: DataFrame, keys: list[str]) -> DataFrame:
    """Add the order of a sentence within its file (1, 2, ...). A file is one text, hence bounded."""
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))


def boilerplate(found: DataFrame, exams: int = V.BOILERPLATE_EXAMS) -> DataFrame:
    """Sentences that occur in at least that many different exams."""
    return (found.groupBy("sentence").agg(F.count_distinct("exam_id").alias("exam_count"))
            .filter(F.col("exam_count") >= exams))


def exam_sentences(found: DataFrame, exams: int = V.BOILERPLATE_EXAMS) -> DataFrame:
    """(exam_id, source_type, sentence), unique, without boilerplate.

    The texts are read once. For each sentence the first `exams` exams are enough to tell whether
    it is boilerplate, and that limit acts before the shuffle, so a sentence printed in every file
    costs each task a few rows. A sentence that stays has all its exams.
    """
    # Rows, not sets of source types: sets would be sorted together where a task has many sentences.
    by_file = found.select("sentence", "exam_id", "source_type").distinct()
    by_exam = Window.partitionBy("sentence").orderBy("exam_id")
    first = by_file.withColumn("__exam", F.dense_rank().over(by_exam)).filter(F.col("__exam") <= exams)
    kept = (first.withColumn("__exams", F.max("__exam").over(Window.partitionBy("sentence")))
            .filter(F.col("__exams") < exams))
    return kept.select("exam_id", "source_type", "sentence")


def with_first_file(sentences: DataFrame) -> DataFrame:
    """Mark, for each sentence, its first file by exam and source type.

    After the boilerplate filter a sentence has fewer files than the threshold allows exams times
    source types, so the groups are small.
    """
    order = Window.partitionBy("sentence").orderBy("exam_id", "source_type")
    return sentences.withColumn("is_first", F.row_number().over(order) == 1)


def distance(sentence: Column, best: int = V.BEST_EXAMPLE_LENGTH) -> Column:
    return F.abs(F.length(sentence) - best)


def word_sentence_pairs(sentences: DataFrame, words: DataFrame, keep: list[str], most: int = T.PIECE_WORDS) -> DataFrame:
    """(word, columns to keep), once for every word and every sentence row that contains it.

    Sentences are scanned by the trie of all words, which finds in each what it holds; nothing is shuffled but the sentences themselves, which
    are dealt out first. What is kept should be short: a number of the sentence rather than its text.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema.fields}

    def take(rows: pa.RecordBatch, piece: T.Piece, points: np.ndarray, starts: np.ndarray, hits: tuple) -> Iterator[pa.RecordBatch]:
        at, _, word = hits
        # A word is in a sentence once, however often it stands there.
        row = np.repeat(np.arange(rows.num_rows), np.diff(starts))[at]
        row, word = np.divmod(T.distinct(row * piece.rows.num_rows + word), max(1, piece.rows.num_rows))
        taken = pa.array(row)
        yield pa.RecordBatch.from_arrays([piece.rows["word"].take(pa.array(word)), *(rows[c].take(taken) for c in keep)], ["word", *keep])

    dealt = sentences.repartition("sentence").select(*dict.fromkeys([*keep, "sentence"]))
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return T.scanned(dealt, words.select("word").distinct(), "sentence", f"word string, {fields}", take, most)
