"""Writers and the loads built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_parquet(df: DataFrame, path: str, sort_by: str | None = None, partition_by: tuple[str, ...] = (),
                 bloom: str | None = None) -> None:
    """Overwrite a table. `sort_by` gives tight page statistics for lookups on that column, `bloom` a Bloom filter in each row group."""
    rows = df.sortWithinPartitions(*partition_by, sort_by) if sort_by else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{bloom}", "true")
    writer.parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def save_per_source(df: DataFrame, path: str) -> None:
    """One folder per source type, so a reader of one source reads only that."""
    save_parquet(df, path, partition_by=("source_type",))


def save_snapshot(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Write a snapshot, or keep the one that is there unless `refresh`."""
    df.write.mode("overwrite" if refresh else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_finished(progress: DataFrame, path: str) -> None:
    """Add finished files to the progress table."""
    progress.write.mode("append").parquet(path)


def replace_sentences(sentences: DataFrame, path: str) -> None:
    """Full reload; a sentence occurs once per exam and source."""
    save_parquet(sentences.dropDuplicates(["exam_id", "source_type", "sentence"]), path)


def frequency_rows(labelled: DataFrame) -> DataFrame:
    """Counts of all files in the shape of the frequency table, in one select."""
    return labelled.select("word", "word_level", "source_type", "exam_id", "frequency", "in_official_wordlist")


def source_rows(files: DataFrame) -> DataFrame:
    """One exam-source row per exam and source type, whatever number of files it has."""
    return files.groupBy("exam_id", "source_type").agg(
        F.max("year").alias("year"), F.max("exam_level").alias("exam_level"),
        F.min("filename").alias("filename"))


def table_columns(spark: SparkSession, names: list[str]) -> dict[str, list[str]]:
    """Columns of those catalog tables that exist."""
    return {n: spark.table(n).columns for n in names if spark.catalog.tableExists(n)}
