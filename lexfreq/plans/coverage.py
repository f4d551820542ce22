"""How much of the corpus the word list covers, and what is left over.

Input: labelled counts with word, exam_id, exam_level, source_type, frequency, word_level,
effective_level, match_type (operators.labels.label_counts_in_full).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexfreq import fixed_values as V
from lexfreq.operators.keyed import columns_per_value
from lexfreq.operators.labels import MATCH_TYPES, NOT_LISTED, level_label, level_order


def match_share(counts: DataFrame) -> DataFrame:
    """Rows and occurrences that have a direct level, with their shares."""
    hit = F.col("word_level").isNotNull()
    figures = counts.agg(
        F.count_if(hit).alias("matched_rows"), F.count("*").alias("total_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("frequency"))), F.lit(0)).alias("matched_occurrences"),
        F.sum("frequency").alias("total_occurrences"))
    return (figures
            .withColumn("row_share", F.try_divide(F.col("matched_rows"), F.col("total_rows")))
            .withColumn("occurrence_share", F.try_divide(F.col("matched_occurrences"), F.col("total_occurrences"))))


def _with_values(df: DataFrame, column: str, values: Sequence[str], order: Column) -> DataFrame:
    """A row for each of the listed values, with zeros where the data has none, and whatever else the data has."""
    spine = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} STRING")
    numbers = [c for c in df.columns if c != column]
    return (spine.join(df, column, "full_outer")
            .select(column, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])
            .orderBy(order, column))


def _in_levels(df: DataFrame, levels: Sequence[int]) -> DataFrame:
    return _with_values(df, "level_label", [f"L{n}" for n in levels] + [NOT_LISTED], level_order(F.col("level_label")))


def words_with_totals(counts: DataFrame, *attributes: str) -> DataFrame:
    """One row per word with its occurrences; attributes depend on the word only."""
    return counts.groupBy("word", *attributes).agg(F.sum("frequency").alias("total_count"))


def by_match_type(counts: DataFrame) -> DataFrame:
    """Words and occurrences per match type, with shares of the whole.

    Words are counted after one row per word is left, so no distinct count is needed.
    """
    per_type = words_with_totals(counts, "match_type").groupBy("match_type").agg(
        F.count("*").alias("words"), F.sum("total_count").alias("occurrences"))
    full = _with_values(per_type, "match_type", MATCH_TYPES, F.array_position(F.lit(list(MATCH_TYPES)), F.col("match_type")))
    # Three rows.
    whole = Window.partitionBy(F.lit(0))
    return (full
            .withColumn("word_share", F.try_divide(F.col("words"), F.sum("words").over(whole)))
            .withColumn("occurrence_share", F.try_divide(F.col("occurrences"), F.sum("occurrences").over(whole))))


def by_level(counts: DataFrame, levels: Sequence[int] = V.LIST_LEVELS) -> DataFrame:
    """Words and occurrences per level label, in the order of the levels, unlisted last."""
    per_level = (words_with_totals(counts, "effective_level")
                 .withColumn("level_label", level_label(F.col("effective_level")))
                 .groupBy("level_label")
                 .agg(F.count("*").alias("words"), F.sum("total_count").alias("occurrences")))
    return _in_levels(per_level, levels)


def words_per_paper(counts: DataFrame, *attributes: str) -> DataFrame:
    return counts.groupBy("exam_level", "word", *attributes).agg(F.sum("frequency").alias("total_count"))


def by_exam_level(counts: DataFrame) -> DataFrame:
    """Covered and uncovered words and occurrences per level of the paper."""
    covered = F.col("effective_level").isNotNull()

    def occurrences(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("total_count"))), F.lit(0))

    return (words_per_paper(counts, "effective_level").groupBy("exam_level")
            .agg(F.count_if(covered).alias("words_matched"), F.count_if(~covered).alias("words_unmatched"),
                 occurrences(covered).alias("occurrences_matched"),
                 occurrences(~covered).alias("occurrences_unmatched"))
            .orderBy("exam_level"))


def level_by_exam_level(counts: DataFrame, exam_levels: Sequence[int], measure: str = "occurrences",
                        levels: Sequence[int] = V.LIST_LEVELS) -> DataFrame:
    """Cross-table of word level and paper level.

    The paper levels are given, so no pass finds them; what has another one, or none, is in exam_level_other.
    """
    cells = words_per_paper(counts, "effective_level").withColumn(
        "level_label", level_label(F.col("effective_level")))
    # A word in papers of several other levels counts once for them.
    figures = {"occurrences": lambda hit: F.sum(F.when(hit, F.col("total_count"))),
               "words": lambda hit: F.count_distinct(F.when(hit, F.col("word")))}
    return _in_levels(cells.groupBy("level_label").agg(*columns_per_value(
        F.col("exam_level"), exam_levels, "exam_level_", figures[measure])), levels)


def decomposed_examples(counts: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent words that were resolved from their parts."""
    return (words_with_totals(counts.filter("match_type = 'decomposed'"), "effective_level", "match_pattern")
            .orderBy(F.desc("total_count"), "word").limit(limit))


def pattern_counts(counts: DataFrame) -> DataFrame:
    """Distinct words and occurrences per decomposition pattern."""
    return (words_with_totals(counts.filter("match_type = 'decomposed'"), "match_pattern")
            .groupBy("match_pattern").agg(F.count("*").alias("words"), F.sum("total_count").alias("occurrences"))
            .orderBy(F.desc("words"), "match_pattern"))


def top_unmatched(counts: DataFrame, limit: int = 15) -> DataFrame:
    return (words_with_totals(counts.filter("match_type = 'unmatched'"))
            .orderBy(F.desc("total_count"), "word").limit(limit))


def funnel(counts: DataFrame) -> DataFrame:
    """Occurrences covered by the list alone, and with decomposition added."""
    def part(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("match_type") == kind, F.col("frequency"))), F.lit(0))

    sums = counts.agg(part("direct").alias("direct"), part("decomposed").alias("decomposed"),
                      F.sum("frequency").alias("whole"))
    stages = F.array(F.struct(F.lit(1).alias("stage"), F.lit("direct").alias("name"), F.col("direct").alias("occurrences")),
                     F.struct(F.lit(2).alias("stage"), F.lit("direct and decomposed").alias("name"),
                              (F.col("direct") + F.col("decomposed")).alias("occurrences")))
    return (sums.select("whole", F.inline(stages))
            .select("stage", "name", "occurrences",
                    F.try_divide(F.col("occurrences"), F.col("whole")).alias("share")))


# --- review of what is left ------------------------------------------------------------

def dictionary_confirmed(review: DataFrame) -> DataFrame:
    return review.filter("in_dictionary")


def strongest_candidates(review: DataFrame, length: int = 2) -> DataFrame:
    """Short words whose characters are known and which both dictionaries hold."""
    return review.filter((F.col("char_length") == length) & F.col("all_chars_known")
                         & F.col("in_segmenter_dict") & F.col("in_dictionary") & ~F.col("likely_noise"))


def triple_signal_noise(review: DataFrame) -> DataFrame:
    return review.filter(F.col("likely_noise") & ~F.col("in_segmenter_dict") & ~F.col("in_dictionary"))


def rescued_words(review: DataFrame) -> DataFrame:
    """Likely noise the segmenter does not know but the dictionary does."""
    return review.filter(F.col("likely_noise") & ~F.col("in_segmenter_dict") & F.col("in_dictionary"))


def repeatable_sample(words: DataFrame, size: int = 15, seed: int = 42) -> DataFrame:
    """The rows with the smallest seeded hash: the same for any partitioning."""
    return words.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("word"))), "word").limit(size)


def review_flags(review: DataFrame) -> DataFrame:
    return review.agg(
        F.count("*").alias("words"), F.count_if("likely_noise").alias("likely_noise"),
        F.count_if("in_segmenter_dict").alias("in_segmenter_dict"),
        F.count_if("in_dictionary").alias("in_dictionary"))


def heuristic_quality(review: DataFrame) -> DataFrame:
    """Confusion counts and scores of both noise heuristics, with the dictionary as truth.

    One pass; a score without a denominator is null.
    """
    truth = F.col("in_dictionary")
    heuristics = {"not likely_noise": ~F.col("likely_noise"), "in_segmenter_dict": F.col("in_segmenter_dict")}
    cells = [("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False)]
    sums = review.agg(*[
        F.count_if((guess == said) & (truth == real)).alias(f"{i}_{cell}")
        for i, guess in enumerate(heuristics.values()) for cell, said, real in cells])
    rows = F.array(*[
        F.struct(F.lit(name).alias("heuristic"), *[F.col(f"{i}_{cell}").alias(cell) for cell, _, _ in cells])
        for i, name in enumerate(heuristics)])
    counted = sums.select(F.inline(rows))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scored = (counted
              .withColumn("precision", F.try_divide(tp, tp + fp))
              .withColumn("recall", F.try_divide(tp, tp + fn)))
    both = F.col("precision") + F.col("recall")
    return (scored
            .withColumn("f1", F.try_divide(F.lit(2) * F.col("precision") * F.col("recall"), both))
            .withColumn("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn)))
