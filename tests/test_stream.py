from pyspark.sql import functions as F

from lexfreq.operators.counts import rollup, word_counts
from lexfreq.plans import corpus as K
from lexfreq.streaming import incremental as N

SCHEMA = "file_id string, exam_id string, source_type string, exam_level int, text string"
COUNTS = "file_id string, word string, source_type string, exam_id string, frequency long"


def to_counts(rows):
    return word_counts(K.spaced_tokens(rows.drop("exam_level")), ("file_id", "exam_id", "source_type"))


def land(spark, folder, name, exam, source, text):
    spark.createDataFrame([(f"{name.partition('-')[0]}.pdf", exam, source, 3, text)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def follow(spark, source, folder, wordlist):
    N.follow_files(spark, f"{source}/*", SCHEMA, to_counts, folder, wordlist, files_per_batch=1,
                   to_files=lambda rows: rows.select("file_id")).awaitTermination()


def state(spark, folder):
    counts = {(r.word, r.source_type, r.exam_id): r.frequency for r in N.current_counts(spark, folder).collect()}
    totals = {(r.word, r.source_type): (r.word_level, r.total_frequency, r.exam_count, r.in_official_wordlist)
              for r in N.current_rollup(spark, folder).collect()}
    return counts, totals


def wordlist_of(spark, *rows):
    return spark.createDataFrame(list(rows), "word string, word_level int")


def test_only_new_files_are_counted(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    land(spark, source, "1", "e1", "reading", "ja ja nein")
    land(spark, source, "2", "e1", "listening", "ja")
    follow(spark, source, folder, words)
    counts, totals = state(spark, folder)
    assert counts == {("ja", "reading", "e1"): 2, ("nein", "reading", "e1"): 1, ("ja", "listening", "e1"): 1}
    assert totals[("ja", "all")] == (1, 3, 1, True) and totals[("nein", "all")] == (None, 1, 1, False)
    follow(spark, source, folder, words)
    assert state(spark, folder) == (counts, totals)
    land(spark, source, "3", "e2", "reading", "nein nein")
    follow(spark, source, folder, words)
    counts, totals = state(spark, folder)
    assert totals[("nein", "all")] == (None, 3, 2, False) and totals[("ja", "all")] == (1, 3, 1, True)


def test_newest_frequency_wins_and_replay_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    first = spark.createDataFrame([("f1", "ja", "reading", "e1", 5), ("f2", "ja", "reading", "e2", 1)], COUNTS)
    second = spark.createDataFrame([("f1", "ja", "reading", "e1", 9)], COUNTS)
    N.apply_batch(first, 0, folder, words)
    N.apply_batch(second, 1, folder, words)
    once = state(spark, folder)
    assert once[0] == {("ja", "reading", "e1"): 9, ("ja", "reading", "e2"): 1}
    assert once[1][("ja", "all")] == (1, 10, 2, True)
    N.apply_batch(first, 0, folder, words)
    N.apply_batch(second, 1, folder, words)
    assert state(spark, folder) == once


def test_rollup_takes_the_level_of_the_current_list(spark, tmp_path):
    folder = str(tmp_path / "out")
    batch = spark.createDataFrame([("f", "ja", "reading", "e1", 5)], COUNTS)
    N.apply_batch(batch, 0, folder, wordlist_of(spark, ("ja", 1)))
    N.apply_batch(batch, 1, folder, wordlist_of(spark, ("ja", 4)))
    later = spark.createDataFrame([("g", "ja", "reading", "e1", 2)], COUNTS)
    N.apply_batch(later, 2, folder, wordlist_of(spark, ("ja", 4)))
    stored = N.current_counts(spark, folder).first()
    assert (stored.frequency, stored.word_level) == (7, 4)
    assert state(spark, folder)[1][("ja", "all")][0] == 4


def test_stream_equals_batch(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    words = wordlist_of(spark, ("a", 1), ("b", 2))
    texts = [(f"e{i % 3}", ("reading", "listening")[i // 3], "a b c " * (i + 1) + "d" * i) for i in range(6)]
    for i, (exam, kind, text) in enumerate(texts):
        land(spark, source, str(i), exam, kind, text)
    follow(spark, source, folder, words)
    files = spark.createDataFrame([("f", e, k, 3, t) for e, k, t in texts], SCHEMA)
    from lexfreq.operators.counts import label_counts
    batch = rollup(label_counts(K.file_counts(files), words))
    assert sorted(map(repr, N.current_rollup(spark, folder).collect())) == sorted(map(repr, batch.collect()))


def test_files_of_one_exam_add_up_across_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    land(spark, source, "1", "e1", "reading", "ja ja")
    land(spark, source, "2", "e1", "reading", "ja nein")
    follow(spark, source, folder, words)
    land(spark, source, "3", "e1", "reading", "")
    follow(spark, source, folder, words)
    counts, totals = state(spark, folder)
    assert counts == {("ja", "reading", "e1"): 3, ("nein", "reading", "e1"): 1} and totals[("ja", "all")] == (1, 3, 1, True)


def test_a_file_that_comes_again_replaces_itself(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    land(spark, source, "1", "e1", "reading", "ja alt alt")
    land(spark, source, "2", "e1", "reading", "alt")
    land(spark, source, "9", "e2", "reading", "weg")
    follow(spark, source, folder, words)
    for again in ("1-b", "9-b"):
        land(spark, source, again, "e1", "reading", "ja neu")
    follow(spark, source, folder, words)
    for _ in range(2):
        counts, totals = state(spark, folder)
        assert counts == {("ja", "reading", "e1"): 2, ("neu", "reading", "e1"): 2, ("alt", "reading", "e1"): 1}
        assert {w: t for (w, s), (_, t, *_) in totals.items() if s == "all"} == {"ja": 2, "neu": 2, "alt": 1}
        N.compact(spark, folder)
    land(spark, source, "2-b", "e1", "reading", "ende")
    follow(spark, source, folder, words)
    counts, totals = state(spark, folder)
    assert counts == {("ja", "reading", "e1"): 2, ("neu", "reading", "e1"): 2, ("ende", "reading", "e1"): 1}
    assert ("alt", "all") not in totals and totals[("ende", "all")] == (None, 1, 1, False)


def spoil(folder, name):
    """Make what a batch has written unreadable."""
    from pathlib import Path
    for file in Path(folder, name).rglob("*.parquet"):
        file.write_bytes(b"not to be read")


def test_a_batch_of_new_files_reads_nothing_of_the_store(spark, tmp_path):
    folder = str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    for n in range(3):
        N.apply_batch(spark.createDataFrame([(f"f{n}", "ja", "reading", f"e{n}", 5)], COUNTS), n, folder, words)
    for n in range(3):
        spoil(folder, f"counts/batch={n}")
        spoil(folder, f"deltas/batch={n}")
    N.apply_batch(spark.createDataFrame([("g", "ja", "reading", "e0", 1), ("g", "neu", "reading", "e0", 2)], COUNTS), 3, folder, words)
    rows = spark.read.schema(N.DELTAS).parquet(f"{folder}/deltas/batch=3").collect()
    assert sorted((r.word, r.frequency, r.files) for r in rows) == [("ja", 1, 1), ("neu", 2, 1)]


def test_a_returning_file_reads_the_batch_that_has_it(spark, tmp_path):
    folder = str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    for n in range(3):
        N.apply_batch(spark.createDataFrame([(f"f{n}", "ja", "reading", "e", n + 1)], COUNTS), n, folder, words)
    spoil(folder, "counts/batch=0")
    spoil(folder, "counts/batch=2")
    N.apply_batch(spark.createDataFrame([("f1", "nein", "reading", "e", 7)], COUNTS), 3, folder, words)
    counts, totals = state(spark, folder)
    assert counts == {("ja", "reading", "e"): 4, ("nein", "reading", "e"): 7} and totals[("ja", "all")] == (1, 4, 1, True)


def test_compaction_beside_a_stream(spark, tmp_path):
    """Batches that come, and the newest one that comes again, after a compaction has begun are neither lost nor counted twice."""
    folder = str(tmp_path / "out")
    words = wordlist_of(spark, ("ja", 1))
    batches = [spark.createDataFrame([(f"f{n % 3}", "ja", "reading", f"e{n % 3}", n + 1), (f"f{n % 3}", f"w{n}", "reading", f"e{n % 3}", 1)], COUNTS)
               for n in range(6)]
    for n in range(4):
        N.apply_batch(batches[n], n, folder, words)
    N.compact(spark, folder)
    once = state(spark, folder)
    N.apply_batch(batches[3], 3, folder, words)
    assert state(spark, folder) == once
    for n in (4, 5):
        N.apply_batch(batches[n], n, folder, words)
    wanted = {("ja", "reading", f"e{n % 3}"): n + 1 for n in (3, 4, 5)} | {(f"w{n}", "reading", f"e{n % 3}"): 1 for n in (3, 4, 5)}
    assert state(spark, folder)[0] == wanted
    N.compact(spark, folder)
    N.expire(spark, folder)
    counts, totals = state(spark, folder)
    assert counts == wanted and totals[("ja", "all")] == (1, 15, 3, True) and ("w0", "all") not in totals


def test_random_histories_equal_a_rebuild(spark, tmp_path):
    import random
    rng = random.Random(4)
    folder = str(tmp_path / "out")
    words = wordlist_of(spark, ("a", 1), ("b", 2))
    files = {}
    for n in range(7):
        batch = {}
        for f in rng.sample(range(6), 2):
            batch[f"f{f}"] = {w: rng.randint(1, 9) for w in rng.sample("abcd", rng.randint(0, 3))}
        files |= batch
        rows = [(f, w, ("reading", "listening")[int(f[1]) % 2], f"e{int(f[1]) % 3}", c) for f, own in batch.items() for w, c in own.items()]
        N.apply_batch(spark.createDataFrame(rows, COUNTS), n, folder, words, spark.createDataFrame([(f,) for f in batch], "file_id string"))
        if n in (2, 5):
            N.compact(spark, folder)
    wanted = {}
    for f, own in files.items():
        for w, c in own.items():
            key = (w, ("reading", "listening")[int(f[1]) % 2], f"e{int(f[1]) % 3}")
            wanted[key] = wanted.get(key, 0) + c
    counts, totals = state(spark, folder)
    assert counts == wanted
    assert {w: (t, e) for (w, s), (_, t, e, _) in totals.items() if s == "all"} == {
        w: (sum(c for k, c in wanted.items() if k[0] == w), len({k[2] for k in wanted if k[0] == w})) for w in {k[0] for k in wanted}}


def test_levels_as_numbers_keep_their_order(spark):
    """Coded levels come back as they were, in the order of the struct, and are added up without sorting the rows."""
    rows = [(batch, level, flag) for batch in (0, 1, (1 << 28) - 1) for level in (None, -(1 << 31), -1, 0, 1, 9, (1 << 31) - 1) for flag in (False, True)]
    frame = spark.createDataFrame([("w", "s", "e", 0, 1, 1, r[1:], r, r[0]) for r in rows], N.DELTAS)
    coded = N._coded(frame)
    order = [r.now for r in frame.orderBy("now").collect()]
    now = coded.orderBy("now").select(
        F.shiftright("now", N._BITS).alias("batch"), N._level(F.col("now")).alias("word_level"), N._flag(F.col("now")).alias("flag"))
    assert [tuple(r) for r in now.collect()] == [tuple(r) for r in order]
    listed = coded.select("batch", N._level(F.col("listed")), N._flag(F.col("listed")))
    assert sorted(map(tuple, listed.collect()), key=str) == sorted(rows, key=str)
    added = N._contributions(coded)
    assert "SortAggregate" not in added._jdf.queryExecution().executedPlan().toString()


def test_a_part_of_the_stream_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from lexfreq.registry import loads

    spark.range(400).selectExpr("id AS doc_id", "'one two three' AS text", "'en' AS lang", "'src1' AS source", "13L AS n_chars").repartition(4).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", "one two")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    landed, follow = [], N.follow_files
    monkeypatch.setattr(N, "follow_files", lambda spark, source, *args, **kw: (
        landed.append((len(spark.read.parquet(source).inputFiles()), kw["files_per_batch"])), follow(spark, source, *args, **kw))[1])
    folder = loads._follow(spark, str(tmp_path))
    scanned = spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions()
    assert landed == [(5 * scanned, scanned)] and scanned > 1
    assert spark.read.parquet(f"{folder}/deltas").select("batch").distinct().count() == 5
    assert {(r.word, r.frequency) for r in N.current_counts(spark, folder).collect()} == {("one", 400), ("two", 400), ("three", 400)}
