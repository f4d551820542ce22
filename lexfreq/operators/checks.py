"""Constraint reports, sanity figures and schema drift."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexfreq import fixed_values as V
from lexfreq.schemas import TABLES


def _report(rows: DataFrame, table: str, keys: list[str], rules: Mapping[str, Column], key_name: str = "key",
            parents: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """(check_name, violations) of one table, in one pass over it.

    Rows that break a rule (a null outcome is no violation), keys that occur more than once, and rows without a
    parent row. Rows are first counted per key, before the shuffle as far as that goes.
    """
    per_key = rows.groupBy(*keys).agg(
        F.count("*").alias("__rows"), *[F.count_if(~rule).alias(f"__broken_{name}") for name, rule in rules.items()])
    figures = {**{name: F.sum(f"__broken_{name}") for name in rules}, key_name: F.count_if(F.col("__rows") > 1)}
    if parents is not None:
        parent, on = parents
        per_key = per_key.join(parent.select(*on).distinct().withColumn("__parent", F.lit(True)), on, "left")
        figures["source"] = F.sum(F.when(F.col("__parent").isNull(), F.col("__rows")))
    one = per_key.agg(*[F.coalesce(figure, F.lit(0)).cast("bigint").alias(name) for name, figure in figures.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f"{table}.{name}").alias("check_name"), F.col(name).alias("violations")) for name in figures])))


def constraint_violations(wordlist: DataFrame, sources: DataFrame, frequencies: DataFrame,
                          sentences: DataFrame, source_types: Iterable[str] = V.SOURCE_TYPES) -> DataFrame:
    """(check_name, violations) for every rule of the five tables."""
    file_key = ["exam_id", "source_type"]
    known = {"source_type": F.col("source_type").isin(list(source_types))}
    level = F.col("word_level").isNotNull() & F.col("word_level").between(*V.LEVELS)
    parents = (sources, file_key)
    reports = [
        _report(wordlist, "wordlist", ["word"], {"word_level": level}, "word"),
        _report(sources, "exam_sources", file_key, {"exam_level": F.col("exam_level").between(*V.LEVELS), **known}),
        _report(frequencies, "word_frequencies", ["word", *file_key], known, parents=parents),
        _report(sentences, "exam_sentences", [*file_key, "sentence"], known, parents=parents),
    ]
    return reduce(DataFrame.unionByName, reports)


def level_per_word(frequencies: DataFrame) -> DataFrame:
    """Words that carry more than one level; the live totals rely on there being none."""
    return (frequencies.groupBy("word")
            .agg(F.count_distinct(F.coalesce("word_level", F.lit(0))).alias("levels"))
            .filter("levels > 1"))


def sanity(counts: DataFrame) -> DataFrame:
    """Empty tokens, non-positive counts and the number of exams."""
    return counts.agg(
        F.count_if(F.length("word") == 0).alias("empty_words"),
        F.count_if(F.col("frequency") <= 0).alias("non_positive"),
        F.count_distinct("exam_id").alias("exams"))


def schema_rows(spark: SparkSession, columns: Mapping[str, Iterable[str]]) -> DataFrame:
    rows = [(table.lower(), c.lower()) for table, names in columns.items() for c in names]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING")


def expected_columns() -> dict[str, list[str]]:
    return {table: schema.fieldNames() for table, schema in TABLES.items()}


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing tables and columns as (problem), tables first by name. More than expected is fine."""
    absent = expected.select("table_name").distinct().join(
        actual.select("table_name").distinct(), "table_name", "left_anti")
    tables = absent.select("table_name", F.lit("").alias("column_name"),
                           F.concat(F.lit("missing table: "), F.col("table_name")).alias("problem"))
    columns = (expected.join(actual, ["table_name", "column_name"], "left_anti")
               .join(absent, "table_name", "left_anti")
               .select("table_name", "column_name",
                       F.concat(F.lit("missing column: "), F.concat_ws(".", "table_name", "column_name"))
                       .alias("problem")))
    return tables.unionByName(columns).orderBy("table_name", "column_name").select("problem")
