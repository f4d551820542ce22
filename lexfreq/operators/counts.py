"""Word counts per file, over the corpus, and the rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

FILE_KEY = ("exam_id", "source_type", "exam_level")


def word_counts(tokens: DataFrame, keys: Sequence[str] = FILE_KEY, word: str = "word",
                output: str = "frequency") -> DataFrame:
    """Occurrences per key and word. Counted in each task before the one shuffle."""
    return tokens.groupBy(*keys, word).agg(F.count("*").alias(output))


def label_counts(counts: DataFrame, wordlist: DataFrame) -> DataFrame:
    """Add the word's official level and the membership flag. A word listed more than once has its lowest level."""
    listed = wordlist.groupBy("word").agg(F.min("word_level").alias("word_level"), F.lit(True).alias("__listed"))
    return (counts.join(listed, "word", "left")
            .withColumn("in_official_wordlist", F.coalesce(F.col("__listed"), F.lit(False)))
            .drop("__listed"))


def rollup(counts: DataFrame) -> DataFrame:
    """Totals per (word, source) and per word over all sources ('all'), in one pass.

    Counts are unique by word, source and exam, so the exams of a source are counted as they are. For all
    sources they are added up per exam first, which makes the number of exams a row count there too. Both
    steps combine in the task before they shuffle, and the first is spread over (word, exam), so a word found
    everywhere is never the work of one task. Levels are functions of the word.
    """
    official = F.bool_or("in_official_wordlist").alias("in_official_wordlist")
    levels = [c for c in ("word_level", "effective_level") if c in counts.columns]
    per_exam = (counts.groupBy("word", *levels, "exam_id").agg(F.sum("frequency").alias("frequency"), official)
                .withColumn("source_type", F.lit("all")))
    columns = ["word", *levels, "source_type", "frequency", "in_official_wordlist"]
    return counts.select(columns).unionByName(per_exam.select(columns)).groupBy("word", *levels, "source_type").agg(
        F.sum("frequency").alias("total_frequency"), F.count("*").alias("exam_count"), official)


def relevel(counts: DataFrame, wordlist: DataFrame) -> DataFrame:
    """Counts with level and flag taken from the current wordlist."""
    return label_counts(counts.drop("word_level", "effective_level", "in_official_wordlist"), wordlist)


def live_totals(counts: DataFrame, *extra) -> DataFrame:
    """Totals per word of whatever rows are given."""
    levels = [c for c in ("word_level", "effective_level") if c in counts.columns]
    return counts.groupBy("word", *levels).agg(
        F.sum("frequency").alias("total_frequency"),
        F.count_distinct("exam_id").alias("exam_count"), *extra)
