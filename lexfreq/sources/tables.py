"""Readers: Parquet, word list CSV, dictionary text, landed word list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexfreq import fixed_values as V
from lexfreq.functions.quality import blank_to_null, checked_level, strip
from lexfreq.operators.keyed import first_per_key
from lexfreq.session import SPREAD


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to as many partitions as the session's SPREAD setting says, if it is set.

    A file of one row group is read by one task, which then also does all work per text. Whether that is worth
    a shuffle is known to whoever sets up the session; without the setting the scan stays as it is.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark in the first header is removed."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("\ufeff").strip().strip('"') for c in rows.columns])


def _text_or_null(rows: DataFrame, column: str):
    return F.col(column) if column in rows.columns else F.lit(None).cast("string")


def wordlist_rows(rows: DataFrame) -> DataFrame:
    """Raw string rows -> (word, pinyin, word_level, definition, definition_th, raw_level).

    The level comes from `hsk_level`, or from `level` where that is blank. `word_level` is null
    for rows a loader has to skip.
    """
    raw = F.coalesce(F.nullif(_text_or_null(rows, "hsk_level"), F.lit("")), _text_or_null(rows, "level"))
    return rows.select(
        strip(F.col("word")).alias("word"),
        F.coalesce(strip(_text_or_null(rows, "pinyin")), F.lit("")).alias("pinyin"),
        checked_level(raw).alias("word_level"),
        blank_to_null(_text_or_null(rows, "definition")).alias("definition"),
        blank_to_null(_text_or_null(rows, "definition_th")).alias("definition_th"),
        raw.alias("raw_level"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("word_level").isNotNull()).drop("raw_level")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("word_level").isNull()).select("word", "raw_level")


def dictionary_entries(lines: DataFrame, line: str = "value") -> DataFrame:
    """(traditional, simplified) of dictionary lines; comments and blank lines are skipped."""
    fields = F.split(F.col(line), " ", 3)
    return (lines.filter(~F.startswith(F.col(line), F.lit("#")) & F.col(line).rlike(r"(?U)\S"))
            .filter(F.size(fields) >= 2)
            .select(fields[0].alias("traditional"), fields[1].alias("simplified")))


def headwords(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("simplified").alias("word")).distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_entries(spark.read.text(path))


def read_wordlist_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages, each an object with a `data` array, or a bare array -> one row per record."""
    pages = spark.read.json(path, multiLine=True)
    if "data" not in pages.columns:
        return pages.withColumn("page", F.input_file_name())
    return pages.select(F.input_file_name().alias("page"), F.explode("data").alias("r")).select("page", "r.*")


def wordlist_snapshot(records: DataFrame, page_order: str = "page") -> DataFrame:
    """Lower-case the names, keep the known columns, one row per id (first page wins)."""
    lowered = records.toDF(*[c.strip().lower() for c in records.columns])
    kept = [c for c in V.WORDLIST_COLUMNS if c in lowered.columns]
    unique = first_per_key(lowered, ["id"], [F.col(page_order), *[F.col(c) for c in kept if c != "id"]])
    return unique.select(*[
        F.col(c).cast("string").try_cast("double").cast("int").alias(c) if c == "level" else F.col(c)
        for c in kept])
