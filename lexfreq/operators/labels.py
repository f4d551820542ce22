"""Match type, effective level and the review flags of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexfreq import fixed_values as V
from lexfreq.operators.decompose import HAN_RULES, RuleSet, resolve_words

MATCH_TYPES = ("direct", "decomposed", "unmatched")
NOT_LISTED = "Not in wordlist"


def label_vocabulary(vocabulary: DataFrame, wordlist: DataFrame, rules: RuleSet = HAN_RULES) -> DataFrame:
    """vocabulary(word) -> (word, word_level, match_pattern, effective_level, match_type).

    A word listed more than once has its lowest level.
    """
    listed = wordlist.groupBy("word").agg(F.min("word_level").alias("word_level"))
    direct = vocabulary.select("word").distinct().join(listed, "word", "left")
    composed = resolve_words(direct.filter("word_level IS NULL"), wordlist, rules)
    both = direct.join(composed, "word", "left")
    return both.select(
        "word", "word_level", "match_pattern",
        F.coalesce("word_level", "decomposed_level").alias("effective_level"),
        match_type(F.col("word_level"), F.col("decomposed_level")).alias("match_type"))


def match_type(direct: Column, decomposed: Column) -> Column:
    return (F.when(direct.isNotNull(), "direct")
            .when(decomposed.isNotNull(), "decomposed")
            .otherwise("unmatched"))


def label_counts_in_full(counts: DataFrame, wordlist: DataFrame, rules: RuleSet = HAN_RULES) -> DataFrame:
    """Counts with level, pattern, effective level and match type of their words."""
    bare = counts.drop("word_level")
    return bare.join(label_vocabulary(bare, wordlist, rules), "word")


def level_label(level: Column) -> Column:
    return F.when(level.isNotNull(), F.concat(F.lit("L"), level.cast("string"))).otherwise(NOT_LISTED)


def level_order(label: Column) -> Column:
    """Sort key of the labels: levels first, unlisted last."""
    return F.when(label == NOT_LISTED, 99).otherwise(F.substr(label, F.lit(2), F.lit(2)).try_cast("int"))


def likely_noise(total: Column, exams: Column) -> Column:
    return (total <= V.NOISE_MAX_COUNT) & (exams == V.NOISE_EXAMS)


def flag_members(words: DataFrame, members: DataFrame, flag: str) -> DataFrame:
    """Add a flag: is the word in the other list?"""
    listed = members.select("word").distinct().withColumn("__in", F.lit(True))
    return (words.join(listed, "word", "left")
            .withColumn(flag, F.col("__in").isNotNull()).drop("__in"))


def characters_known(words: DataFrame, wordlist: DataFrame) -> DataFrame:
    """words(word, ...) -> the same rows with all_chars_known: is every character listed by itself?

    """
    # One entry at most for every character there is, so the set fits a scalar subquery.
    singles = wordlist.filter((F.length("word") == 1) & F.col("word_level").isNotNull())
    known = singles.agg(F.array_join(F.collect_set("word"), "")).scalar()
    unknown = F.call_function("translate", F.col("word"), F.coalesce(known, F.lit("")), F.lit(""))
    return words.withColumn("all_chars_known", unknown == "")


def unmatched_review(labelled: DataFrame, wordlist: DataFrame, segmenter_words: DataFrame,
                     dictionary_words: DataFrame) -> DataFrame:
    """One row per unmatched word with the signals a reviewer needs."""

    def seen(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")

    words = (labelled.filter(F.col("match_type") == "unmatched")
             .groupBy("word")
             .agg(F.sum("frequency").alias("total_count"),
                  F.count_distinct("exam_id").alias("exam_count"),
                  seen("exam_level").alias("exam_levels_seen"),
                  seen("source_type").alias("source_types_seen"))
             .withColumn("char_length", F.length("word"))
             .withColumn("likely_noise", likely_noise(F.col("total_count"), F.col("exam_count"))))
    flagged = characters_known(words, wordlist)
    return flag_members(flag_members(flagged, segmenter_words, "in_segmenter_dict"),
                        dictionary_words, "in_dictionary")
