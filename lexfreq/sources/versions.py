"""Tables in versions: loads that are seen as a whole or not at all.

A folder holds data folders, which are written once and never changed, and a manifest for each version: which data folders its parts are in.
A version is committed by creating the manifest with the next number, which a file system lets one writer do; who comes second
is told to retry. A reader takes the newest manifest once and stays with its files, whatever is committed meanwhile, until
`expire` deletes data that none of the versions to keep refers to.

`KeyedTable` deals rows to buckets by the hash of their key. An upsert reads and writes the buckets that its rows fall into; the
manifest takes the others over as they are. Rows that break the table's rules stop the commit: they are set aside, with the rules they break,
and the version before stays the current one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lexfreq.operators.keyed import merge_latest
from lexfreq.session import stored

_BUCKET = "bucket"
# From claiming a version's number to its manifest it takes a moment; a claim that is this old is of a writer that was lost.
CLAIM_SECONDS = 600


class Conflict(RuntimeError):
    """Another writer has committed since; read again and retry."""


class Refused(RuntimeError):
    """Rows break rules; the version before stays. `figures` says how many rows break each rule."""

    def __init__(self, figures: dict[str, int]) -> None:
        super().__init__(f"rows that break rules: {figures}")
        self.figures = figures


class Versions:
    """The versions of a folder. A manifest maps the names of parts to data folders."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("versions").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        system, root = self._system(), self._path("versions")
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def current(self) -> int:
        """The number of the newest version, 0 if there is none."""
        return max(self.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the newest, if none is given."""
        number = self.current() if version is None else version
        if not number:
            return {}
        stream = self._system().open(self._path(f"versions/{number:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def new_data(self, name: str) -> str:
        """The name of a data folder that nobody else writes."""
        return f"data/{name}-{uuid.uuid4().hex}"

    def commit(self, manifest: dict, base: int) -> int:
        """Make this the version behind `base`.

        The manifest is written under a name of its own and then renamed, which fails if the version exists: it is
        never seen in part, and of two writers one has it.
        """
        system, target = self._system(), self._path(f"versions/{base + 1:08d}.json")
        if base != self.current() or system.exists(target):
            raise Conflict(f"version {base + 1} of {self.folder} exists")
        draft = self._path(f"versions/draft-{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        finally:
            stream.close()
        # A local file system renames over an existing file, so the name is first claimed by creating it exclusively.
        claim = self._path(f"versions/claim-{base + 1:08d}")
        try:
            system.create(claim, False).close()
        except Exception as taken:
            system.delete(draft, False)
            if "FileAlreadyExists" not in str(taken) and "already exists" not in str(taken):
                raise
            if time.time() - system.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS and not system.exists(target):
                system.delete(claim, False)
            raise Conflict(f"version {base + 1} of {self.folder} is being written") from None
        if not system.rename(draft, target):
            raise Conflict(f"version {base + 1} of {self.folder} exists")
        return base + 1

    def expire(self, keep: int = 1) -> list[int]:
        """Delete all versions but the newest `keep`, and data that only they refer to; the numbers that went.

        Data of a load that is being written is referred to by no version yet: not to be run beside one.
        """
        numbers = self.numbers()
        kept, gone = numbers[-keep:], numbers[:-keep]
        system = self._system()
        needed = {str(p).split("/")[1] for n in kept for p in _leaves(self.manifest(n)) if str(p).startswith("data/")}
        for number in gone:
            system.delete(self._path(f"versions/{number:08d}.json"), False)
        root = self._path("data")
        if system.exists(root):
            for status in system.listStatus(root):
                if status.getPath().getName() not in needed:
                    system.delete(status.getPath(), True)
        return gone


def _leaves(value) -> list:
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    return [x for v in value for x in _leaves(v)] if isinstance(value, list) else [value]


@dataclass
class KeyedTable:
    """A table that is unique by its keys, in buckets of their hash.

    `rules` are conditions by name that each row has to meet (a null outcome breaks none); `parents` are tables in which
    the named columns of a row have to be found.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    keys: Sequence[str]
    buckets: int = 16
    rules: Mapping[str, Column] = field(default_factory=dict)
    parents: Mapping[str, tuple[DataFrame, Sequence[str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.folder)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given. The frame stays with that version."""
        return self._rows(self.versions.manifest(version).get("buckets", {}).values())

    def _rows(self, parts) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows with `broken`, the names of the rules that they break."""
        broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in self.rules.items()]
        for i, (name, (parent, on)) in enumerate(self.parents.items()):
            rows = rows.join(parent.select(*on).distinct().withColumn(f"__parent{i}", F.lit(True)), list(on), "left")
            broken.append(F.when(F.col(f"__parent{i}").isNull(), F.lit(name)))
        listed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
        return rows.select(*self.schema.fieldNames(), listed.alias("broken"))

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket and say where. Raises Refused if any breaks a rule: then those rows are set aside instead."""
        names = [*self.rules, *self.parents]
        data = self.versions.new_data("rows")
        seen = Observation()
        figures = [F.count_if(F.array_contains("broken", n)).alias(n) for n in names]
        watched = self._dealt(self._checked(rows)).observe(seen, F.count("*").alias("rows"), *figures)
        # Offending rows go to a partition of their own, so rows are written, checked and counted in one pass.
        (watched.withColumn("ok", F.size("broken") == 0).repartition(_BUCKET, F.size("broken") == 0).sortWithinPartitions(*self.keys)
         .write.partitionBy("ok", _BUCKET).parquet(f"{self.folder}/{data}"))
        system, root = self.versions._system(), self.versions._path(f"{data}/ok=true")
        if system.exists(self.versions._path(f"{data}/ok=false")):
            counted = seen.get
            raise Refused({n: counted[n] for n in names if counted[n]})
        if not system.exists(root):
            return {}
        return {(name := s.getPath().getName()).rpartition("=")[2]: f"{data}/ok=true/{name}" for s in system.listStatus(root)}

    def replace(self, rows: DataFrame) -> int:
        """Commit these rows, which are unique by the keys, as the next version."""
        base = self.versions.current()
        return self.versions.commit({"buckets": self._written(rows)}, base)

    def upsert(self, rows: DataFrame, order: Sequence[Column], update_cols: Sequence[str] | None = None) -> int:
        """Merge rows into the newest version (see merge_latest) and commit the next one; only buckets that the rows fall into are rewritten."""
        base = self.versions.current()
        old = self.versions.manifest(base).get("buckets", {})
        # The rows are read for their buckets and again for the merge; they are derived once.
        rows = stored(rows.select(*self.schema.fieldNames()), "delivery")
        # At most as many numbers as there are buckets.
        touched = {str(r[0]) for r in self._dealt(rows).select(_BUCKET).distinct().collect()}
        before = self._rows(old[b] for b in sorted(touched & old.keys()))
        merged = merge_latest(before, rows, list(self.keys), order, update_cols)
        return self.versions.commit({"buckets": {**{b: p for b, p in old.items() if b not in touched}, **self._written(merged)}}, base)

    def set_aside(self) -> DataFrame:
        """Rows that broke rules in loads that were refused, with the rules that each breaks."""
        fields = StructType([*self.schema.fields]).add("broken", ArrayType(StringType()))
        rows = self.spark.read.schema(StructType([*fields.fields]).add("ok", "boolean").add(_BUCKET, "integer")).option("basePath", f"{self.folder}/data")
        system, root = self.versions._system(), self.versions._path("data")
        found = [f"{self.folder}/data/{s.getPath().getName()}/ok=false" for s in (system.listStatus(root) if system.exists(root) else [])
                 if system.exists(self.versions._path(f"data/{s.getPath().getName()}/ok=false"))]
        return rows.parquet(*found).drop("ok", _BUCKET) if found else self.spark.createDataFrame([], fields)
