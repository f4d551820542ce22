"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# How many partitions the rows of a table read by one task are dealt out to; see sources.tables.spread.
SPREAD = "spark.lexfreq.spread"

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Small shuffles feed costly steps here; merging them into 1 MB partitions would idle the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
}


def local_session(cores: str | int = 8, memory: str = "16g", **settings) -> SparkSession:
    """A local session for tests and bench. On a cluster the submitter configures the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexfreq")
    defaults = {**SESSION_DEFAULTS, "spark.driver.memory": memory,
                "spark.sql.shuffle.partitions": str(cores), SPREAD: str(cores)}
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Only a local session, whose one process is driver and executor, may go without one. It gets a folder of
    its own, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        own = Path(tempfile.gettempdir()) / f"lexfreq-{context.applicationId}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own.as_uri())
    return context.getCheckpointDir().rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver was started from. Once per application.

    The archive is program code; Spark's own file server hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="lexfreq-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "lexfreq.zip", "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(folder / "lexfreq.zip"))
    _SHIPPED.add(context.applicationId)


def ready_for_checkpoint(spark: SparkSession) -> None:
    """Point the context at the shared folder so that DataFrame.checkpoint() can be used."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lexfreq/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession, part: str | None = None) -> None:
    """Delete what the application has stored in the shared folder, or the part of it with that path; to be called when a job is through with it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(part or _own_folder(spark))
    if part and not part.startswith(f"{_own_folder(spark)}/"):
        raise ValueError(f"{part} is not scratch of this application")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each job when it ends, for as long as this lasts."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For a table several steps read: it is derived once, survives lost executors, and later steps
    read only the columns they need. Its shuffle files go as soon as it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with dropped_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
