"""Intermediate tables in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexfreq.session import drop_scratch, dropped_shuffles, ready_for_checkpoint, scratch_path, ship_package


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow by a function that uses this package, which the workers may not have of their own."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        # The worker lives on between tasks; Arrow's pool and the C library would keep what this one has freed.
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


# Folders of the stages that are being set up, the innermost last; and, by application, that of the stage before the current one.
_STAGES: list[str] = []
_BEFORE: dict[str, str] = {}


@contextmanager
def stage_folder(spark: SparkSession, name: str, last: bool = False) -> Iterator[None]:
    """A folder for what a stage of a pipeline writes. A stage begins when the result of the one before is written, so that one's folder goes.

    The last stage's folder stays, for nothing tells when its result has been read.
    """
    application = spark.sparkContext.applicationId
    before = _BEFORE.pop(application, None)
    if before:
        drop_scratch(spark, before)
    _STAGES.append(scratch_path(spark, name))
    try:
        with dropped_shuffles(spark):
            yield
    finally:
        folder = _STAGES.pop()
    if not last:
        _BEFORE[application] = folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for none of the columns to have them, in whatever capitals."""
    taken, free = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        free.append(name)
    return free


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Derive a table once: later steps read the files, whichever executors are lost meanwhile.

    A small frame made on the driver goes the same way, for then Spark knows its size and can choose how to join it.
    """
    path = f"{_STAGES[-1]}/{name}-{uuid.uuid4().hex}" if _STAGES else scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> Iterator[DataFrame]:
    """The same in hash buckets of a column, so that joins on it leave the table where it is; table and files are deleted at the end.

    Rows should be partitioned by that column into as many parts already, else a task writes to many buckets.
    """
    spark = df.sparkSession
    path, own = f"{_STAGES[-1]}/{name}-{uuid.uuid4().hex}" if _STAGES else scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "snappy").saveAsTable(own)
    try:
        yield spark.table(own)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {own}")
        drop_scratch(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same for small tables; Spark removes the files once nothing refers to the frame."""
    ready_for_checkpoint(df.sparkSession)
    return df.checkpoint()
