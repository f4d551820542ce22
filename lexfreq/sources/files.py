"""File listings, and the choice of the best copy per exam and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions import names
from lexfreq.operators.keyed import first_per_key, top_k_per_group

FILE_KEY = ["exam_id", "source_type"]


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = V.INVENTORY_EXTENSIONS,
               recursive: bool = False) -> DataFrame:
    """(filepath, filename, size_mb). File contents are not read: that column is pruned."""
    pattern = "*.{" + ",".join(f"{e},{e.upper()}" for e in extensions) + "}"
    found = (spark.read.format("binaryFile")
             .option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", str(recursive).lower())
             .load(folder))
    return found.select(
        F.col("path").alias("filepath"),
        F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")).alias("filename"),
        F.bround(F.col("length") / 1048576, 2).alias("size_mb"))


def describe_files(listed: DataFrame, exam_pattern: str = V.EXAM_NAME) -> DataFrame:
    """Add exam, level, source type and copy score; names without an exam id are left out."""
    name = F.col("filename")
    return (listed
            .withColumn("exam_id", names.exam_id(name, exam_pattern))
            .withColumn("exam_level", names.exam_level(name, exam_pattern))
            .withColumn("source_type", names.source_type(name))
            .withColumn("copy_score", names.copy_score(name))
            .filter(F.col("exam_id").isNotNull()))


def skipped_files(listed: DataFrame, exam_pattern: str = V.EXAM_NAME) -> DataFrame:
    return listed.filter(names.exam_id(F.col("filename"), exam_pattern).isNull())


def _copy_order() -> list[Column]:
    return [F.col("copy_score").asc(), F.col("filename").asc()]


def best_copies(described: DataFrame) -> DataFrame:
    """One file per exam and source: the lowest copy score, then the first name."""
    return first_per_key(described, FILE_KEY, _copy_order()).drop("copy_score")


def duplicate_files(described: DataFrame) -> DataFrame:
    """Every file of an exam and source that has several, with the one that is kept.

    One row per file, so that an exam with very many copies stays spread over tasks.
    """
    groups = described.groupBy(*FILE_KEY).agg(
        F.count("*").alias("copies"),
        F.min(F.struct("copy_score", "filename"))["filename"].alias("kept"))
    return (described.join(groups.filter("copies > 1"), FILE_KEY)
            .select(*FILE_KEY, "filename", "kept", (F.col("filename") == F.col("kept")).alias("is_kept")))


def only_in_one_source(described: DataFrame) -> DataFrame:
    """Exams that are seen in one source type only."""
    return (described.groupBy("exam_id")
            .agg(F.min("source_type").alias("source_type"), F.max("source_type").alias("__last"))
            .filter("source_type = __last").drop("__last"))


def pending_files(files: DataFrame, progress: DataFrame, done: Column) -> DataFrame:
    """Files that no finished progress row names; failed ones come again."""
    finished = progress.filter(done).select("filename").distinct()
    return files.join(finished, "filename", "left_anti")


def best_copies_ranked(described: DataFrame, keep: int) -> DataFrame:
    """The first few copies per exam and source, numbered."""
    return top_k_per_group(described, FILE_KEY, _copy_order(), keep, rank="copy_rank")
