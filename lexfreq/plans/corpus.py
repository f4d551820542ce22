"""From extracted text to labelled counts, rollup and example sentences; the five tables, written and read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions import text as X
from lexfreq.operators import cleaning, counts as C, sentences as S
from lexfreq.operators.decompose import RuleSet
from lexfreq.operators.labels import label_vocabulary
from lexfreq.operators.ngram_index import write_index
from lexfreq.operators.segmentation import segmented_tokens
from lexfreq.schemas import TABLES
from lexfreq.session import dropped_shuffles
from lexfreq.sources.sinks import save_parquet
from lexfreq.sources.versions import Versions

Counting = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """The frames the queries read."""

    wordlist: DataFrame     # word, pinyin, word_level, definition, definition_th
    sources: DataFrame      # exam_id, source_type, year, exam_level, filename
    frequencies: DataFrame  # word, word_level, effective_level, source_type, exam_id, frequency, in_official_wordlist
    aggregates: DataFrame   # word, word_level, effective_level, source_type, total_frequency, exam_count, in_official_wordlist
    sentences: DataFrame | None  # exam_id, source_type, sentence
    index: str | None = None     # folder of the stored trigram index of the sentences


def spaced_tokens(files: DataFrame, text: str = "text", pattern: str = rf"({X.LETTERS}+)") -> DataFrame:
    """One row per token of a script that separates words; the text column is dropped."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(X.tokens(F.col(text), pattern)).alias("word"))


def tokens_to_wordlist(texts: DataFrame, text: str = "text") -> DataFrame:
    """A stand-in word list: the distinct tokens of a text, levelled by length (1..6)."""
    return (spaced_tokens(texts.select(text), text).distinct()
            .select("word", F.least(F.lit(6), F.length("word")).alias("word_level")))


def file_counts(files: DataFrame) -> DataFrame:
    """Counts of words that are separated in the text."""
    return C.word_counts(spaced_tokens(files.select(*C.FILE_KEY, "text")))


def segmented_counts(lexicon: DataFrame, script: str = V.HAN) -> Counting:
    """Counts of words that are found in unbroken runs of a script, by a weighted list (word, weight)."""
    return lambda files: segmented_tokens(files.select(*C.FILE_KEY, "text"), lexicon, script)


def cleaned(files: DataFrame, transcripts: Column | None = None, pairs: DataFrame | None = None,
            phrases: DataFrame | None = None) -> DataFrame:
    """Files as they are counted: repeats taken out of transcripts, then the script converted by a list of phrases or a pairs table."""
    if transcripts is not None:
        files = cleaning.dedupe_transcripts(files, transcripts, output="text")
    if phrases is not None:
        return cleaning.convert_phrases(files, phrases)
    if pairs is not None:
        files = files.withColumn("text", cleaning.simplify_text(F.col("text"), pairs))
    return files


def build(files: DataFrame, wordlist: DataFrame, sources: DataFrame, sentences: DataFrame | None = None,
          count: Counting = file_counts, rules: RuleSet | None = None) -> Corpus:
    """Count the files, label the counts and roll them up.

    `files` are the texts to count (see `cleaned`), `count` finds their words. With `rules`, words that are not
    listed get their effective level by decomposition; without, it is the level of the list.
    `sentences` may be left out when only words are asked for.
    """
    labelled = C.label_counts(count(files), wordlist)
    if rules is None:
        labelled = labelled.withColumn("effective_level", F.col("word_level"))
    else:
        levels = label_vocabulary(labelled, wordlist, rules).select("word", "effective_level")
        labelled = labelled.join(levels, "word")
    frequencies = labelled.select("word", "word_level", "effective_level", "source_type", "exam_id", "frequency",
                                  "in_official_wordlist")
    return Corpus(wordlist, sources, frequencies, C.rollup(frequencies), sentences)


def sentences_of(files: DataFrame, ends: str = V.SENTENCE_ENDS, script: str = V.HAN,
                 glued: bool = True) -> DataFrame:
    found = S.candidates(files.select("exam_id", "source_type", "text"), "text", ends, script, glued)
    return S.exam_sentences(found.select("exam_id", "source_type", "sentence"))


def write(corpus: Corpus, folder: str) -> int:
    """Write the five tables, with the time columns of their schemas, as the next version of the folder; its number.

    The tables are seen together, when all of them are written; readers of the version before keep theirs. Counts and rollup are
    partitioned by source type, dealt out by word and sorted by it, with Bloom filters: a query on one source reads that source, one on a
    word a row group of one file. The rollup is derived from the counts as written. Sentences get an index by trigrams. The shuffle files of
    each step go when it is written, so the disk holds those of one step and not of the whole load.
    """
    spark = corpus.wordlist.sparkSession
    versions = Versions(spark, folder)
    base = versions.current()
    paths = {name: versions.new_data(name) for name in TABLES if name != "exam_sentences" or corpus.sentences is not None}
    full = {name: f"{folder}/{path}" for name, path in paths.items()}
    now = F.current_timestamp()
    with dropped_shuffles(spark):
        save_parquet(corpus.wordlist.withColumn("created_at", now), full["wordlist"])
        save_parquet(corpus.sources.withColumn("processed_at", now), full["exam_sources"])
        save_parquet(corpus.frequencies.withColumn("created_at", now).repartition("word"), full["word_frequencies"], "word", ("source_type",), "word")
        stored = spark.read.parquet(full["word_frequencies"])
        save_parquet(C.rollup(stored).withColumn("updated_at", now), full["frequency_aggregates"], "word", ("source_type",), "word")
        index = None
        if corpus.sentences is not None:
            save_parquet(corpus.sentences.withColumn("created_at", now), full["exam_sentences"])
            index = versions.new_data("sentence_index")
            write_index(spark.read.parquet(full["exam_sentences"]).select("exam_id", "source_type", "sentence"), f"{folder}/{index}")
    return versions.commit({"tables": paths, "index": index}, base)


def table_paths(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, str]:
    """Where the tables of a version are."""
    return {name: f"{folder}/{path}" for name, path in Versions(spark, folder).manifest(version)["tables"].items()}


def read(spark: SparkSession, folder: str, sentences: bool = True, version: int | None = None) -> Corpus:
    """The corpus of a folder, in its newest version if none is given. It stays with that version."""
    manifest = Versions(spark, folder).manifest(version)
    if not manifest:
        raise FileNotFoundError(f"no corpus in {folder}")
    tables = {name: spark.read.parquet(f"{folder}/{path}") for name, path in manifest["tables"].items() if sentences or name != "exam_sentences"}
    index = manifest.get("index") if sentences else None
    return Corpus(tables["wordlist"], tables["exam_sources"], tables["word_frequencies"], tables["frequency_aggregates"],
                  tables.get("exam_sentences"), f"{folder}/{index}" if index else None)
