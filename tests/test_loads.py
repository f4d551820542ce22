import json

from pyspark.sql import functions as F

from lexfreq.operators import checks
from lexfreq.operators.counts import label_counts, relevel, rollup
from lexfreq.operators.keyed import first_per_key, global_rank, merge_latest, top_k_per_group
from lexfreq.operators.labels import label_vocabulary
from lexfreq.schemas import TABLES, WORD_COUNTS
from lexfreq.sources import sinks, tables

HEADER = "word,pinyin,hsk_level,definition,definition_th\n"


def loaded(spark, path, text, bom=False):
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return tables.wordlist_rows(tables.read_csv(spark, str(path)))


def test_wordlist_csv(spark, tmp_path):
    rows = loaded(spark, tmp_path / "w.csv", HEADER + "苹果,píng guǒ,1,hello,แอปเปิล\n 老师 ,lǎo shī,1.0, ,\nหมา,,nan,x,\nbad,,99,x,\nnone,,,,\n", bom=True)
    good = {r.word: r for r in tables.accepted(rows).collect()}
    assert set(good) == {"苹果", "老师"}
    assert good["苹果"].pinyin == "píng guǒ" and good["苹果"].word_level == 1
    assert good["老师"].definition is None and good["老师"].word_level == 1
    assert {r.word for r in tables.rejected(rows).collect()} == {"หมา", "bad", "none"}


def test_other_level_column(spark, tmp_path):
    rows = loaded(spark, tmp_path / "w.csv", "word,level,hsk_level\na,3,\nb,4,2\n")
    assert {(r.word, r.word_level) for r in rows.collect()} == {("a", 3), ("b", 2)}


def test_wordlist_upsert(spark, tmp_path):
    old = tables.accepted(loaded(spark, tmp_path / "a.csv", HEADER + "苹果,old,1,was,\n老师,x,1,,\n"))
    new = tables.accepted(loaded(spark, tmp_path / "b.csv", HEADER + "苹果,new,2,,\n虽然,y,3,,\n"))
    merged = {r.word: r for r in merge_latest(old, new, ["word"], [F.asc("pinyin")]).collect()}
    assert set(merged) == {"苹果", "老师", "虽然"}
    assert merged["苹果"].pinyin == "new" and merged["苹果"].word_level == 2 and merged["苹果"].definition is None


def test_last_row_of_a_load_wins(spark):
    schema = "word string, word_level int, line int"
    old = spark.createDataFrame([], schema)
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], schema)
    assert [r.word_level for r in merge_latest(old, new, ["word"], order=[F.desc("line")]).collect()] == [2]


def test_sources_by_exam_and_type(spark):
    schema = "exam_id string, source_type string, year int, exam_level int, filename string"
    old = spark.createDataFrame([("e", "reading", 2020, 3, "a.pdf")], schema)
    new = spark.createDataFrame([("e", "reading", 2020, 3, "b.pdf"), ("e", "listening", None, 3, "c.mp3")], schema)
    got = {(r.source_type, r.filename) for r in merge_latest(old, new, ["exam_id", "source_type"], [F.asc("filename")]).collect()}
    assert got == {("reading", "b.pdf"), ("listening", "c.mp3")}


COUNTS = "word string, word_level int, source_type string, exam_id string, frequency long, in_official_wordlist boolean"


def test_rollup_values(spark):
    rows = [("苹果", 1, "reading", "e1", 5, True), ("苹果", 1, "reading", "e2", 2, True), ("苹果", 1, "listening", "e1", 3, True)]
    for parts in (1, 16):
        out = rollup(spark.createDataFrame(rows, COUNTS).repartition(parts)).collect()
        assert {(r.source_type, r.total_frequency, r.exam_count) for r in out} == {
            ("reading", 7, 2), ("listening", 3, 1), ("all", 10, 2)}


def test_frequency_upsert_keeps_level_and_flag(spark):
    keys = ["word", "source_type", "exam_id"]
    old = spark.createDataFrame([("a", None, "reading", "e", 5, False)], COUNTS)
    new = spark.createDataFrame([("a", 2, "reading", "e", 9, True), ("b", 3, "reading", "e", 1, True)], COUNTS)
    once = merge_latest(old, new, keys, [F.asc("frequency")], update_cols=["frequency"])
    twice = merge_latest(once, new, keys, [F.asc("frequency")], update_cols=["frequency"])
    expected = {("a", None, 9, False), ("b", 3, 1, True)}
    for merged in (once, twice):
        assert {(r.word, r.word_level, r.frequency, r.in_official_wordlist) for r in merged.collect()} == expected
    wordlist = spark.createDataFrame([("a", 4)], "word string, word_level int")
    assert {(r.word, r.word_level, r.in_official_wordlist) for r in relevel(once, wordlist).collect()} == {
        ("a", 4, True), ("b", None, False)}


def test_snapshot_is_kept_unless_refreshed(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    one, two = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("b",)], "word string")
    assert sinks.save_snapshot(one, path).first().word == "a"
    assert sinks.save_snapshot(two, path).first().word == "a"
    assert sinks.save_snapshot(two, path, refresh=True).first().word == "b"


def test_landed_pages(spark, tmp_path):
    pages = [[{"id": 1, "Word": "苹果", "level": "1", "extra": 1}, {"id": 2, "Word": "好", "level": "x", "extra": 1}],
             [{"id": 2, "Word": "again", "level": "2", "extra": 1}, {"id": 3, "Word": "书", "level": "2.0", "extra": 1}]]
    for i, records in enumerate(pages):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"data": records, "metadata": {"has_next": i == 0}}), encoding="utf-8")
    out = tables.wordlist_snapshot(tables.read_wordlist_pages(spark, str(tmp_path)))
    assert out.columns == ["id", "word", "level"]
    assert {tuple(r) for r in out.collect()} == {(1, "苹果", 1), (2, "好", None), (3, "书", 2)}


def test_dictionary_text(spark, tmp_path):
    (tmp_path / "d.u8").write_text("# comment\n\n什麼 什么 [shen2 me5] /what/\n苹果 苹果 [ni3 hao3] /hello/\n嗎 吗 [ma5] /x/\n嘛 吗 [ma5] /y/\nlone\n", encoding="utf-8")
    entries = tables.read_dictionary(spark, str(tmp_path / "d.u8"))
    assert {r.word for r in tables.headwords(entries).collect()} == {"什么", "苹果", "吗"}


def test_parquet_round_trip_and_split(spark, tmp_path):
    rows = [("a", 1, "e", 3, "reading", 2, None, 1, "direct"), ("b", None, "e", 3, "listening", 1, None, None, "unmatched")]
    df = spark.createDataFrame(rows, WORD_COUNTS)
    sinks.save_parquet(df, str(tmp_path / "c"), sort_by="word")
    assert sorted(map(tuple, tables.read_parquet(spark, str(tmp_path / "c"), WORD_COUNTS).collect())) == sorted(rows)
    sinks.save_per_source(df, str(tmp_path / "s"))
    assert [r.word for r in spark.read.parquet(str(tmp_path / "s/source_type=listening")).collect()] == ["b"]
    sinks.save_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2


def test_sentences_are_replaced(spark, tmp_path):
    schema = "exam_id string, source_type string, sentence string"
    path = str(tmp_path / "s")
    sinks.replace_sentences(spark.createDataFrame([("e", "reading", "x")] * 2, schema), path)
    sinks.replace_sentences(spark.createDataFrame([("e", "reading", "y")] * 2, schema), path)
    assert [r.sentence for r in spark.read.parquet(path).collect()] == ["y"]


def test_constraints(spark, seed):
    clean = checks.constraint_violations(seed.wordlist, seed.sources, seed.frequencies, seed.sentences)
    assert {r.violations for r in clean.collect()} == {0}
    words = seed.wordlist.union(spark.createDataFrame([("苹果", "", 12, None, None)], seed.wordlist.schema))
    orphan = seed.sentences.union(spark.createDataFrame([("nope", "video", "s")], seed.sentences.schema))
    found = {r.check_name: r.violations for r in checks.constraint_violations(
        words, seed.sources, seed.frequencies, orphan).collect()}
    assert {k for k, v in found.items() if v} == {
        "wordlist.word_level", "wordlist.word", "exam_sentences.source_type", "exam_sentences.source"}


def test_schema_drift(spark):
    def drift(expected, actual):
        rows = checks.schema_drift(checks.schema_rows(spark, expected), checks.schema_rows(spark, actual))
        return [r.problem for r in rows.collect()]

    assert drift({"wordlist": ["word", "pinyin"]}, {}) == ["missing table: wordlist"]
    assert drift({"wordlist": ["word", "pinyin", "definition_th"]}, {"Wordlist": ["word", "Pinyin"]}) == [
        "missing column: wordlist.definition_th"]
    assert drift({"wordlist": ["word"]}, {"wordlist": ["word", "pinyin"]}) == []
    assert drift(checks.expected_columns(), {t: s.fieldNames() for t, s in TABLES.items()}) == []


def test_schema_drift_of_catalog_tables(spark):
    spark.createDataFrame([("a",)], "word string").createOrReplaceTempView("wordlist")
    actual = checks.schema_rows(spark, sinks.table_columns(spark, ["wordlist", "exam_sources"]))
    expected = checks.schema_rows(spark, {"wordlist": ["word", "pinyin"], "exam_sources": ["exam_id"]})
    assert [r.problem for r in checks.schema_drift(expected, actual).collect()] == [
        "missing table: exam_sources", "missing column: wordlist.pinyin"]
    spark.catalog.dropTempView("wordlist")


def test_sanity_and_levels(spark, seed):
    row = checks.sanity(seed.frequencies).first()
    assert (row.empty_words, row.non_positive, row.exams) == (0, 0, 2)
    assert checks.level_per_word(seed.frequencies).count() == 0


def test_labels_come_from_the_list(spark, seed):
    out = label_counts(seed.frequencies.drop("word_level", "in_official_wordlist"), seed.wordlist.select("word", "word_level"))
    assert {(r.word, r.word_level, r.in_official_wordlist) for r in out.collect()} == {
        ("苹果", 1, True), ("老师", 1, True), ("虽然", 4, True), ("机器猫", None, False)}


def test_rank_is_global(spark):
    rows = [(f"w{i % 97:03d}-{i}", (i * 7919) % 50) for i in range(2000)]
    expected = {w: i + 1 for i, (w, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for parts in (1, 16):
        df = spark.createDataFrame(rows, "word string, n int").repartition(parts)
        got = {r.word: r.rank for r in global_rank(df, [F.desc("n"), F.asc("word")]).collect()}
        assert got == expected


def test_ranked_rows_are_not_moved_again(spark):
    ranked = global_rank(spark.range(100).repartition(8).withColumn("n", F.col("id") % 7), [F.desc("n"), F.asc("id")])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ExistingRDD" not in plan
    # One shuffle is of the sizes of the partitions, one gathers these.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange SinglePartition") == 1
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 101))


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v").repartition(8)
    top = top_k_per_group(df, ["g"], [F.desc("v")], 3, rank="r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    assert {(r.g, r.v, r.r) for r in top.collect()} == {(g, 998 + g - 2 * i, i + 1) for g in (0, 1) for i in range(3)}
    assert first_per_key(df, ["g"], [F.asc("v")]).orderBy("g").collect() == [(0, 0), (1, 1)]


def test_a_list_with_repeated_words_does_not_multiply_counts(spark):
    counts = spark.createDataFrame([("a", "reading", "e", 5)], "word string, source_type string, exam_id string, frequency long")
    listed = spark.createDataFrame([("a", 4), ("a", 1), ("a", None)], "word string, word_level int")
    assert [(r.word_level, r.frequency, r.in_official_wordlist) for r in label_counts(counts, listed).collect()] == [(1, 5, True)]
    assert [(r.word_level, r.effective_level) for r in label_vocabulary(counts, listed).collect()] == [(1, 1)]
