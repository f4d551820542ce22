"""Rankings, rank-frequency, heat map and file summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions.quality import length_bin, method_label
from lexfreq.operators.keyed import columns_per_value, global_rank, top_k_per_group


def by_total() -> list[Column]:
    return [F.desc("total_count"), F.asc("word")]


def word_totals(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by, "word").agg(F.sum("frequency").alias("total_count"))


def top_overall(counts: DataFrame, limit: int = 10) -> DataFrame:
    return word_totals(counts).orderBy(*by_total()).limit(limit)


def top_per(counts: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent words per value of a column, nulls left out."""
    totals = word_totals(counts.filter(F.col(column).isNotNull()), column)
    return top_k_per_group(totals, [column], by_total(), k, rank="word_rank")


def top_word_per_file(counts: DataFrame) -> DataFrame:
    """The most frequent word of each exam and source."""
    totals = word_totals(counts, "exam_level", "exam_id", "source_type")
    return (totals.groupBy("exam_level", "exam_id", "source_type")
            .agg(F.min(F.struct((-F.col("total_count")).alias("n"), "word")).alias("best"))
            .select("exam_id", "source_type", "exam_level", F.col("best.word").alias("top_word"),
                    (-F.col("best.n")).alias("top_word_count"))
            .orderBy("exam_level", "exam_id", "source_type"))


def top_summary(counts: DataFrame, limit: int = 50) -> DataFrame:
    """Top words with exam count, level and match type."""
    return (counts.groupBy("word")
            .agg(F.sum("frequency").alias("total_count"), F.count_distinct("exam_id").alias("exam_count"),
                 F.max("effective_level").alias("effective_level"), F.max("match_type").alias("match_type"))
            .orderBy(*by_total()).limit(limit))


def rank_frequency(counts: DataFrame) -> DataFrame:
    """Rank of every word by total, and the ideal total: the top word's divided by the rank."""
    totals = word_totals(counts)
    ranked = global_rank(totals, by_total())
    top = ranked.agg(F.max("total_count")).scalar()
    return ranked.select("word", "total_count", "rank", (top / F.col("rank")).alias("ideal_count"))


def heat_map(counts: DataFrame, words: int = 15) -> DataFrame:
    """(word, exam_id, total_count) of the top words, long form."""
    top = top_overall(counts, words).select("word")
    totals = word_totals(counts.join(top, "word", "left_semi"), "exam_id")
    return totals.select("word", "exam_id", "total_count")


def heat_map_matrix(counts: DataFrame, exam_ids: Sequence[str], words: int = 15) -> DataFrame:
    """The heat map with one column per exam the caller names, zero where a word is missing, and one for all other exams."""
    return heat_map(counts, words).groupBy("word").agg(*columns_per_value(
        F.col("exam_id"), exam_ids, "", lambda hit: F.sum(F.when(hit, F.col("total_count")))))


def list_size_against_seen(wordlist: DataFrame, counts: DataFrame) -> DataFrame:
    """Words on the list and words seen, per level."""
    listed = (wordlist.filter("word_level IS NOT NULL").groupBy("word_level")
              .agg(F.count("*").alias("listed_words")))
    seen = (counts.filter("effective_level IS NOT NULL").select("word", "effective_level").distinct()
            .groupBy(F.col("effective_level").alias("word_level")).agg(F.count("*").alias("seen_words")))
    return listed.join(seen, "word_level", "full_outer").fillna(0).orderBy("word_level")


def words_per_level(wordlist: DataFrame) -> DataFrame:
    return wordlist.groupBy("word_level").agg(F.count("*").alias("words")).orderBy(F.col("word_level").asc_nulls_last())


def missing_levels(wordlist: DataFrame) -> DataFrame:
    low, high = V.LEVELS
    all_levels = wordlist.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("word_level"))
    return all_levels.join(wordlist.select("word_level").distinct(), "word_level", "left_anti").orderBy("word_level")


# --- file summaries ------------------------------------------------------------------------

def files_per_source(files: DataFrame) -> DataFrame:
    return files.groupBy("exam_level", "source_type").agg(F.count("*").alias("files"))


def extraction_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("exam_level", "source_type").agg(
        F.count("*").alias("files"), F.avg("text_length").alias("avg_chars"),
        F.count_if(F.col("text_length") == 0).alias("empty_files"))


def length_groups(files: DataFrame) -> DataFrame:
    """Files by length; what is in none of the groups is `other`."""
    return (files.withColumn("length_group", F.coalesce(length_bin(F.col("text_length")), F.lit("other")))
            .groupBy("length_group")
            .agg(F.count("*").alias("files"), F.avg("text_length").alias("avg_chars"),
                 F.avg("size_mb").alias("avg_mb")))


def note_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("notes").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "notes")


def method_summary(files: DataFrame) -> DataFrame:
    per_page = F.bround(F.col("text_length") / F.greatest(F.col("pages"), F.lit(1)), 1)
    return (files.withColumn("method", method_label(F.col("notes"))).withColumn("chars_per_page", per_page)
            .groupBy("method")
            .agg(F.count("*").alias("files"), F.avg("text_length").alias("avg_chars"),
                 F.avg("pages").alias("avg_pages"), F.avg("chars_per_page").alias("avg_chars_per_page"),
                 F.avg("size_mb").alias("avg_mb")))


def method_by_exam_level(files: DataFrame, exam_levels: Sequence[int]) -> DataFrame:
    """Files per method and paper level; levels not given, and files without one, are in exam_level_other."""
    return files.withColumn("method", method_label(F.col("notes"))).groupBy("method").agg(*columns_per_value(
        F.col("exam_level"), exam_levels, "exam_level_", F.count_if))


def combine_extractions(reading: DataFrame, listening: DataFrame) -> DataFrame:
    """Both kinds of files as one table, in the order of exams."""
    return reading.unionByName(listening).orderBy("exam_level", "exam_id", "source_type", "filename")
