from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexfreq.operators.keyed import merge_latest
from lexfreq.sources.versions import Conflict, KeyedTable, Refused, Versions

SCHEMA = StructType().add("word", "string").add("level", "integer").add("n", "long")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def table(spark, folder, **options):
    return KeyedTable(spark, str(folder), SCHEMA, ["word"], **options)


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def times(folder):
    return {f: f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}


def test_a_reader_stays_with_its_version(spark, tmp_path):
    own = table(spark, tmp_path / "t")
    assert listed(own.read()) == []
    own.replace(rows(spark, ("a", 1, 1), ("b", 2, 2)))
    open_before = own.read()
    own.upsert(rows(spark, ("a", 9, 9), ("c", 3, 3)), [F.asc("level")])
    assert listed(open_before) == [("a", 1, 1), ("b", 2, 2)]
    assert listed(own.read()) == [("a", 9, 9), ("b", 2, 2), ("c", 3, 3)] == listed(table(spark, tmp_path / "t").read())
    assert listed(own.read(1)) == [("a", 1, 1), ("b", 2, 2)]
    own.replace(rows(spark, ("z", 1, 1)))
    assert own.versions.expire(2) == [1] and listed(own.read(2)) != [] and listed(own.read()) == [("z", 1, 1)]
    assert own.versions.expire() == [2] and own.versions.numbers() == [3]


def test_of_two_writers_one_is_told_to_retry(spark, tmp_path):
    one, other = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "t"))
    base = one.current()
    assert one.commit({"x": "data/1"}, base) == 1
    with pytest.raises(Conflict):
        other.commit({"x": "data/2"}, base)
    assert other.manifest() == {"x": "data/1"}
    # Both find the version free; the name is claimed by one.
    other.current = lambda: 1
    one.current = lambda: 1
    one.commit({"x": "data/3"}, 1)
    (tmp_path / "t/versions/00000002.json").unlink()
    with pytest.raises(Conflict):
        other.commit({"x": "data/4"}, 1)


def test_a_writer_that_comes_second_changes_nothing(spark, tmp_path):
    own = table(spark, tmp_path / "t")
    own.replace(rows(spark, ("a", 1, 1)))
    written = own._written

    def slow(merged):
        out = written(merged)
        table(spark, tmp_path / "t").upsert(rows(spark, ("b", 2, 2)), [F.asc("level")])
        return out

    own._written = slow
    with pytest.raises(Conflict):
        own.upsert(rows(spark, ("a", 5, 5)), [F.asc("level")])
    assert listed(table(spark, tmp_path / "t").read()) == [("a", 1, 1), ("b", 2, 2)]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    own = table(spark, tmp_path / "t", buckets=8)
    own.replace(spark.range(200).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).alias("level"), F.col("id").alias("n")))
    before, old = times(tmp_path / "t"), own.versions.manifest()["buckets"]
    own.upsert(rows(spark, ("w7", 5, -1)), [F.asc("level")], update_cols=["n"])
    new = own.versions.manifest()["buckets"]
    changed = [b for b in old if old[b] != new[b]]
    assert len(changed) == 1 and len(old) == len(new) == 8
    after = times(tmp_path / "t")
    assert all(after[f] == t for f, t in before.items())
    assert {Path(f).parents[2].name for f in after.keys() - before.keys()} == {new[changed[0]].split("/")[1]}
    assert own.read().filter("word = 'w7'").first() == ("w7", 1, -1) and own.read().count() == 200


@pytest.mark.parametrize("update_cols", [None, ["n"]])
def test_upserts_equal_merging_whole_tables(spark, tmp_path, update_cols):
    own = table(spark, tmp_path / "t", buckets=5)
    whole = rows(spark)
    for step in range(4):
        new = spark.range(30).select(F.concat(F.lit("w"), (F.col("id") * (step + 3) % 41).cast("string")).alias("word"),
                                     F.lit(step).alias("level"), (F.col("id") * 10 + step).alias("n"))
        own.upsert(new, [F.desc("n")], update_cols)
        whole = merge_latest(whole, new, ["word"], [F.desc("n")], update_cols)
    assert listed(own.read()) == listed(whole)


def test_bad_rows_leave_the_version_before(spark, tmp_path):
    parents = {"known": (spark.createDataFrame([("a",), ("b",), ("x",)], "word string"), ["word"])}
    own = table(spark, tmp_path / "t", rules={"level": F.col("level").between(1, 9), "count": F.col("n") > 0}, parents=parents)
    own.replace(rows(spark, ("a", 1, 1), ("b", None, 2)))
    with pytest.raises(Refused) as refused:
        own.upsert(rows(spark, ("a", 12, 0), ("x", 3, 3), ("lost", 4, 4)), [F.asc("level")])
    assert refused.value.figures == {"level": 1, "count": 1, "known": 1}
    assert own.versions.current() == 1 and listed(own.read()) == sorted([("a", 1, 1), ("b", None, 2)])
    assert sorted((r.word, tuple(r.broken)) for r in own.set_aside().collect()) == [("a", ("level", "count")), ("lost", ("known",))]
    own.upsert(rows(spark, ("x", 3, 3)), [F.asc("level")])
    assert own.versions.current() == 2 and own.read().count() == 3


def test_empty_loads(spark, tmp_path):
    own = table(spark, tmp_path / "t")
    own.replace(rows(spark))
    assert listed(own.read()) == [] and own.versions.current() == 1 and listed(own.set_aside()) == []
    own.upsert(rows(spark), [F.asc("level")])
    assert listed(own.read()) == []


def test_a_lost_writer_blocks_no_version(spark, tmp_path, monkeypatch):
    own = Versions(spark, str(tmp_path / "t"))
    own.commit({"x": "data/1"}, 0)
    (tmp_path / "t/versions/claim-00000002").write_text("")
    with pytest.raises(Conflict):
        own.commit({"x": "data/2"}, 1)
    monkeypatch.setattr("lexfreq.sources.versions.CLAIM_SECONDS", -1)
    with pytest.raises(Conflict):
        own.commit({"x": "data/2"}, 1)
    assert own.commit({"x": "data/2"}, 1) == 2
