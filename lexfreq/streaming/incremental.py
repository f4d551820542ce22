"""Counts and rollup kept up to date as files arrive, by signed deltas.

Every micro-batch writes, below folders named batch=<id>: `counts`, the words of its files, sorted by file; `deltas`, what
it adds to and takes from the totals of (word, source, exam); and last `files`, the files it has counted. A batch
that runs again overwrites what it wrote, so a replay after a failure changes nothing.

A delta row says by how much the frequency and the number of supporting files of a key change, and in which batch the contribution
it changes was made (`origin`). New files add theirs; a file that comes again also takes away what it said before, which is read from
the counts of the one batch that has it. So a batch reads and writes rows in proportion to its own files, never the store.
Readers add deltas up; keys without support are gone. Exam and file counts follow from the keys, so the rollup needs no counting of its own.

`compact` adds up the deltas of all batches but the newest into one folder, which readers take instead of them. It can run beside a
stream: only the newest batch is ever replayed, and later ones are simply not in it yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexfreq.operators.counts import label_counts, rollup

KEY = ["word", "source_type", "exam_id"]
FILES = "file_id STRING, batch BIGINT"
COUNTS = "file_id STRING, word STRING, source_type STRING, exam_id STRING, frequency BIGINT, batch BIGINT"
# `listed` is level and membership by the list at the time of the contribution, `now` by the newest list that the word has met.
_LISTED = "struct<word_level:int,in_official_wordlist:boolean>"
_NOW = "struct<batch:bigint,word_level:int,in_official_wordlist:boolean>"
DELTAS = (f"word STRING, source_type STRING, exam_id STRING, origin BIGINT, frequency BIGINT, files BIGINT, "
          f"listed {_LISTED}, now {_NOW}, batch BIGINT")
COMPACTED = f"{DELTAS}, upto BIGINT"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _compacted_upto(spark: SparkSession, folder: str) -> int | None:
    """The last batch of the newest compaction that is complete."""
    return _stored(spark, f"{folder}/compactions", "upto BIGINT").agg(F.max("upto")).first()[0]


# Level and flag as one number in the order of the struct, with a batch of up to 28 bits in front: of numbers Spark keeps a running maximum
# in a hash table, of structs only over rows that it has sorted.
_LOWEST, _BITS = -(1 << 31), 34


def _code(listed: Column) -> Column:
    level = F.coalesce(listed["word_level"].cast("bigint") - F.lit(_LOWEST) + 1, F.lit(0).cast("bigint"))
    return level * 2 + listed["in_official_wordlist"].cast("bigint")


def _level(code: Column) -> Column:
    level = F.nullif(F.shiftright(code, 1).bitwiseAND(F.lit((1 << (_BITS - 1)) - 1)), F.lit(0).cast("bigint"))
    return (level + F.lit(_LOWEST) - 1).cast("int")


def _flag(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1).cast("bigint")) == 1


def _coded(rows: DataFrame) -> DataFrame:
    """Deltas with `listed` and `now` as numbers."""
    now = F.shiftleft(F.col("now.batch"), _BITS) + _code(F.col("now"))
    return rows.select(*KEY, "origin", "frequency", "files", _code(F.col("listed")).alias("listed"), now.alias("now"), "batch")


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    """All delta rows that count, coded: those of the newest compaction and of the batches behind it."""
    return _coded(_delta_rows(spark, folder))


def _delta_rows(spark: SparkSession, folder: str) -> DataFrame:
    upto = _compacted_upto(spark, folder)
    rows = _stored(spark, f"{folder}/deltas", DELTAS)
    if upto is None:
        return rows
    compacted = spark.read.schema(COMPACTED).parquet(f"{folder}/compacted").filter(F.col("upto") == upto).drop("upto")
    return rows.filter(F.col("batch") > upto).unionByName(compacted)


def _contributions(rows: DataFrame) -> DataFrame:
    """One row per key and origin: what is left of the contributions, with the newest level met; no support makes `files` 0."""
    return rows.groupBy(*KEY, "origin").agg(
        F.sum("frequency").alias("frequency"), F.sum("files").alias("files"),
        F.max(F.when(F.col("files") > 0, F.col("listed"))).alias("listed"), F.max("now").alias("now"))


def _per_key(contributions: DataFrame) -> DataFrame:
    """Keys with support, their level and flag being those of the oldest contribution that is left."""
    return (contributions.filter("files > 0").groupBy(*KEY)
            .agg(F.sum("frequency").alias("frequency"), F.min_by("listed", "origin").alias("listed"))
            .select(*KEY, "frequency", _level(F.col("listed")).alias("word_level"), _flag(F.col("listed")).alias("in_official_wordlist")))


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per word, source and exam: its files added up, with level and flag of the oldest of them."""
    return _per_key(_contributions(_deltas(spark, folder)))


def current_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all words that are in some file, with the level of the list that the word met last."""
    deltas = _deltas(spark, folder)
    newest = deltas.groupBy("word").agg(F.max("now").alias("now"))
    # Deltas of a batch are unique, so there is nothing to add up before the shuffle; dealt out by key once, they serve both steps.
    rows = _contributions(deltas.select(*KEY, "origin", "frequency", "files").withColumns({
        c: F.lit(0).cast("bigint") for c in ("listed", "now")}).repartition(*KEY))
    alive = rows.filter("files > 0").groupBy(*KEY).agg(F.sum("frequency").alias("frequency"))
    levelled = alive.join(newest.select("word", _level(F.col("now")).alias("word_level"), _flag(F.col("now")).alias("in_official_wordlist")), "word")
    return rollup(levelled).select("word", "word_level", "source_type", "total_frequency", "exam_count", "in_official_wordlist")


def _returning(spark: SparkSession, folder: str, batch: int, seen: DataFrame) -> DataFrame:
    """(file_id, batch): files of the batch that an earlier one has, and the last that has them."""
    listed = _stored(spark, f"{folder}/files", FILES).filter(F.col("batch") < batch)
    return listed.join(seen, "file_id", "left_semi").groupBy("file_id").agg(F.max("batch").alias("batch"))


def apply_batch(counts: DataFrame, batch: int, folder: str, wordlist: DataFrame, files: DataFrame | None = None) -> None:
    """Write a batch of counts(file_id, word, source_type, exam_id, frequency), added up by file and key, and its deltas.

    `files` (file_id) names the files of the batch where some may have no words. A file's newest version before this batch is taken
    back as a whole. Levels come from the word list as it is now.
    """
    spark = counts.sparkSession
    written = f"{folder}/counts/batch={batch}"
    (counts.groupBy("file_id", *KEY).agg(F.sum("frequency").cast("bigint").alias("frequency"))
     .sortWithinPartitions("file_id").write.mode("overwrite").parquet(written))
    own = spark.read.schema(COUNTS).parquet(written).drop("batch")
    # A row for each file, so they are counted as they are, in each task before the shuffle.
    changes = own.groupBy(*KEY).agg(F.sum("frequency").alias("frequency"), F.count("file_id").alias("files"))
    changes = changes.withColumn("origin", F.lit(batch).cast("bigint"))
    seen = (counts.select("file_id") if files is None else files.select("file_id")).distinct()
    again = _returning(spark, folder, batch, seen)
    # At most as many numbers as batches that hold files of this one; only their folders are read.
    batches = [r.batch for r in again.select("batch").distinct().collect()]
    if batches:
        before = _stored(spark, f"{folder}/counts", COUNTS).filter(F.col("batch").isin(batches))
        taken = before.join(again, ["file_id", "batch"], "left_semi").groupBy(*KEY, F.col("batch").alias("origin")).agg(
            (-F.sum("frequency")).alias("frequency"), (-F.count_distinct("file_id")).alias("files"))
        changes = changes.unionByName(taken)
    level = [F.col("word_level"), F.col("in_official_wordlist")]
    rows = label_counts(changes, wordlist.select("word", "word_level")).select(
        *KEY, "origin", "frequency", "files", F.struct(*level).alias("listed"),
        F.struct(F.lit(batch).cast("bigint").alias("batch"), *level).alias("now"))
    rows.write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}")
    seen.write.mode("overwrite").parquet(f"{folder}/files/batch={batch}")


def compact(spark: SparkSession, folder: str) -> None:
    """Add up the deltas of all batches but the newest; may run while a stream writes to the folder.

    A batch counts as written once its files are listed, and a stream replays no batch but its newest. So what is
    added up here does not change meanwhile. The compaction is listed when it is complete; until then, and for readers that have
    begun before, the older folders are there.
    """
    numbers = [r.batch for r in _stored(spark, f"{folder}/files", FILES).select("batch").distinct().collect()]
    before = _compacted_upto(spark, folder)
    ready = [n for n in numbers if n < max(numbers)]
    if not ready or (before is not None and max(ready) <= before):
        return
    upto = max(ready)
    ready_rows = _deltas(spark, folder).filter(F.col("batch") <= upto)
    rows = _contributions(ready_rows)
    newest = ready_rows.groupBy("word").agg(F.max("now").alias("__now"))
    now = F.struct(F.shiftright("__now", _BITS).alias("batch"), _level(F.col("__now")).alias("word_level"), _flag(F.col("__now")).alias("in_official_wordlist"))
    listed = F.struct(_level(F.col("listed")).alias("word_level"), _flag(F.col("listed")).alias("in_official_wordlist"))
    kept = rows.filter("files > 0").join(newest, "word").select(
        *KEY, "origin", "frequency", "files", listed.alias("listed"), now.alias("now"))
    (kept.withColumn("batch", F.lit(upto).cast("bigint")).sortWithinPartitions("word")
     .write.mode("overwrite").parquet(f"{folder}/compacted/upto={upto}"))
    spark.createDataFrame([(upto,)], "upto BIGINT").write.mode("append").parquet(f"{folder}/compactions")


def expire(spark: SparkSession, folder: str) -> None:
    """Delete the deltas that a compaction has taken up, and older compactions; to be run when no reader uses them any more.

    Counts and files stay: files that come again are taken back from them.
    """
    upto = _compacted_upto(spark, folder)
    if upto is None:
        return
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    for name, last in (("deltas", upto), ("compacted", upto - 1)):
        root = path(f"{folder}/{name}")
        system = root.getFileSystem(context._jsc.hadoopConfiguration())
        if system.exists(root):
            for status in system.listStatus(root):
                number = status.getPath().getName().rpartition("=")[2]
                if number.lstrip("-").isdigit() and int(number) <= last:
                    system.delete(status.getPath(), True)


def follow_files(spark: SparkSession, source: str, schema: StructType | str, to_counts: Callable[[DataFrame], DataFrame],
                 folder: str, wordlist: DataFrame, files_per_batch: int | None = None,
                 to_files: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Count files that were not counted before, then stop.

    `to_counts` turns arrived rows into counts per file, `to_files` into the ids of their files.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        apply_batch(to_counts(batch), number, folder, wordlist, to_files(batch) if to_files else None)

    return (reader.parquet(source).writeStream
            .foreachBatch(take)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start())
