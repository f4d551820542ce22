import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexfreq.functions import reading
from lexfreq.operators import checks
from lexfreq.operators.counts import label_counts, rollup
from lexfreq.operators.decompose import PLAIN_RULES
from lexfreq.plans import corpus as K, word_queries as Q
from lexfreq.plans.corpus import Corpus
from lexfreq.schemas import TABLES
from lexfreq.sources.sinks import source_rows


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def words(df):
    return [r.word for r in df.collect()]


def test_exams(seed):
    rows = Q.list_exams(seed.sources).collect()
    assert [(r.exam_id, r.exam_level, r.source_types) for r in rows] == [
        ("k07", 4, ["listening", "reading"]), ("m11", 5, ["reading"])]


def test_exams_without_level_come_last(spark, seed):
    more = seed.sources.union(spark.createDataFrame(
        [("0000", "reading", None, None, "x")], seed.sources.schema))
    assert [r.exam_id for r in Q.list_exams(more).collect()][-1] == "0000"
    assert [r.exam_id for r in Q.exam_groups(more).collect()] == ["k07", "m11", "0000"]
    assert [r.exam_id for r in Q.exam_groups(more, " M1").collect()] == ["m11"]
    assert [r.exam_level for r in Q.exam_levels(more).collect()] == [4, 5]


def total(corpus, **scope):
    return Q.top_words_total(corpus, **scope).first().total_count


def test_top_uses_the_rollup(seed):
    rows = Q.top_words(seed).collect()
    assert [r.word for r in rows][:2] == ["苹果", "虽然"]
    assert {r.word for r in rows[2:]} == {"老师", "机器猫"}
    assert rows[1].total_frequency == 9 and rows[0].pinyin == "píng guǒ"
    assert total(seed) == 4


def test_top_by_word_level(seed):
    assert set(words(Q.top_words(seed, word_level=1))) == {"苹果", "老师"}
    assert total(seed, word_level=1) == 2


def test_top_by_source(seed):
    assert pairs(Q.top_words(seed, source_type="reading"), "word", "total_frequency") == {
        "苹果": 9, "老师": 2, "虽然": 9, "机器猫": 1}


def test_limit_does_not_change_the_total(seed):
    assert len(words(Q.top_words(seed, limit=1))) == 1
    assert total(seed) == 4


def test_top_by_exam_level_counts_live(seed):
    rows = {r.word: r for r in Q.top_words(seed, exam_level=4).collect()}
    assert rows["苹果"].total_frequency == 10 and rows["苹果"].exam_count == 1
    assert rows["苹果"].source_type == "all" and rows["老师"].source_type == "reading"
    assert "虽然" not in rows and total(seed, exam_level=4) == 2


def test_top_by_exams(seed):
    assert set(words(Q.top_words(seed, exam_ids=["m11"]))) == {"苹果", "虽然", "机器猫"}
    assert pairs(Q.top_words(seed, exam_ids=["k07"], source_type="listening"), "word", "total_frequency") == {"苹果": 4}
    assert pairs(Q.top_words(seed, exam_ids=["m11"]), "word", "total_frequency")["虽然"] == 11


def test_long_id_lists_are_joined(seed):
    ids = ["m11"] + [f"x{i}" for i in range(1500)] * 2
    assert set(words(Q.top_words(seed, exam_ids=ids))) == {"苹果", "虽然", "机器猫"}


def test_empty_scope(seed):
    assert words(Q.top_words(seed, word_level=6)) == [] and total(seed, word_level=6) == 0


@pytest.mark.parametrize("bad", [
    dict(word_level=0), dict(word_level=10), dict(exam_level=10), dict(limit=0), dict(limit=10001),
    dict(source_type="video")])
def test_top_refuses(seed, bad):
    with pytest.raises(ValueError):
        Q.top_words(seed, **bad)


@pytest.mark.parametrize("bad", [dict(limit=501), dict(limit=0), dict(word_level=0), dict(source_type="video")])
def test_compare_refuses(seed, bad):
    with pytest.raises(ValueError):
        Q.compare_words(seed, **bad)


def sides(df):
    rows = sorted(df.collect(), key=lambda r: r.side_rank)
    return ({r.word: r.total_frequency for r in rows if r.side == "in_official_wordlist"},
            {r.word: r.total_frequency for r in rows if r.side == "not_in_official_wordlist"})


def test_compare(seed):
    listed, unlisted = sides(Q.compare_words(seed))
    assert list(listed) == ["苹果", "虽然", "老师"] and list(unlisted) == ["机器猫"]
    listed, unlisted = sides(Q.compare_words(seed, word_level=1))
    assert set(listed) == {"苹果", "老师"} and not unlisted


def test_compare_live(seed):
    listed, unlisted = sides(Q.compare_words(seed, exam_id="m11"))
    assert listed == {"虽然": 11, "苹果": 3} and list(unlisted) == ["机器猫"]
    assert sides(Q.compare_words(seed, exam_level=4))[0] == {"苹果": 10, "老师": 2}
    assert sides(Q.compare_words(seed, exam_level=4, source_type="reading"))[0] == {"苹果": 6, "老师": 2}
    assert sides(Q.compare_words(seed, exam_id="nope")) == ({}, {})


def test_filters_combine_with_an_exam(seed):
    assert sides(Q.compare_words(seed, exam_id="k07", source_type="listening"))[0] == {"苹果": 4}


def test_occurrences(seed):
    rows = Q.word_occurrences(seed, "苹果").collect()
    assert [r.frequency for r in rows] == [6, 4, 3]
    assert rows[0].filename == "k07.pdf" and rows[2].year == 2022
    assert Q.word_aggregates(seed, "苹果").count() == 3
    assert Q.word_occurrences(seed, "没有").count() == 0


@pytest.mark.parametrize("text", ["", "字" * 51])
def test_query_length(seed, text):
    for call in (Q.word_occurrences, Q.word_aggregates, Q.word_detail, Q.example_sentences):
        with pytest.raises(ValueError):
            call(seed, text)


def test_detail(seed):
    row = Q.word_detail(seed, "苹果").first()
    assert row.in_wordlist and row.pinyin == "píng guǒ" and row.definition_th == "แอปเปิล"
    assert (row.sentence_total, row.file_total) == (2, 2)
    found = Q.example_sentences(seed, "苹果").collect()
    assert {(r.exam_id, r.source_type) for r in found} == {("k07", "reading"), ("k07", "listening")}
    assert found[0].exam_level == 4


def test_detail_of_unlisted_word(seed):
    row = Q.word_detail(seed, "机器猫").first()
    assert not row.in_wordlist and row.pinyin is None and row.word_level is None
    assert (row.sentence_total, row.file_total) == (0, 0)
    assert Q.example_sentences(seed, "机器猫").count() == 0


def test_search_has_no_wildcards(spark, seed):
    odd = spark.createDataFrame([("e", "reading", "100% 对\\_")], "exam_id string, source_type string, sentence string")
    corpus = Corpus(seed.wordlist, seed.sources, seed.frequencies, seed.aggregates, seed.sentences.union(odd))
    for text, hits in (("%", 1), ("_", 1), ("\\", 1), ("1%对", 0)):
        assert Q.sentences_with(corpus, text).count() == hits


def test_examples_spread_over_files(spark, seed):
    rows = [("a", "reading", "字" * n + "猫") for n in (3, 19, 30)] + [("b", "reading", "字" * 19 + "猫"), ("b", "reading", "猫" * 5)]
    sentences = spark.createDataFrame(rows, "exam_id string, source_type string, sentence string")
    sources = spark.createDataFrame([("a", "reading", 1, 3, "fa"), ("b", "reading", 1, 4, "fb")], seed.sources.schema)
    corpus = Corpus(seed.wordlist, sources, seed.frequencies, seed.aggregates, sentences)
    found = [(r.exam_id, r.sentence) for r in Q.example_sentences(corpus, "猫").collect()]
    assert found == [("a", "字" * 19 + "猫"), ("b", "猫" * 5)]


def test_batch_detail_equals_single_detail(spark, seed):
    listed = {r.word: (r.sentence_total, r.file_total) for r in Q.sentence_totals_of_all_words(seed).collect()}
    assert listed == {"苹果": (2, 2), "老师": (1, 1), "虽然": (1, 1)}
    batch = Q.examples_of_all_words(seed).collect()
    for word in ("苹果", "老师", "虽然"):
        single = [(r.sentence, r.filename) for r in Q.example_sentences(seed, word).collect()]
        assert single == [(r.sentence, r.filename) for r in sorted(
            (r for r in batch if r.word == word), key=lambda r: r.example_rank)]


def test_both_routes_agree_on_everything(spark, seed):
    counts = label_counts(seed.frequencies.drop("word_level", "in_official_wordlist"),
                          seed.wordlist.select("word", "word_level"))
    corpus = Corpus(seed.wordlist, seed.sources, counts, rollup(counts), seed.sentences)
    stored = pairs(Q.top_words(corpus), "word", "total_frequency")
    live = pairs(Q.top_words(corpus, exam_ids=["k07", "m11"]), "word", "total_frequency")
    assert stored == live


def test_summary_and_pages(seed):
    row = Q.scope_summary(Q.scope_words(seed)).first()
    assert (row.total_occurrences, row.official_words, row.unofficial_words, row.max_exam_count) == (25, 3, 1, 2)
    items = Q.ranked_items(Q.scope_words(seed))
    assert words(Q.word_page(items, 1, page_size=3))[:2] == ["苹果", "虽然"]
    assert words(Q.word_page(items, 9, page_size=3)) == words(Q.word_page(items, 2, page_size=3))
    assert len(words(Q.word_page(items, 2, page_size=3))) == 1
    assert words(Q.word_page(items.filter("false"), 3)) == []


def test_reading_search(seed):
    items = Q.scope_words(seed).join(seed.wordlist.select("word", "pinyin"), "word", "left")
    assert set(words(Q.search_words(items, " "))) == {"苹果", "老师", "虽然"}
    assert words(Q.search_words(items, "PINGguo")) == ["苹果"]
    assert words(Q.search_words(items, "lǎo S")) == ["老师"]
    assert words(Q.search_words(items, "然")) == ["虽然"]
    assert words(Q.search_words(items, "机")) == []


def test_plain_reading(spark):
    row = spark.range(1).select(reading.plain_reading(F.lit("Kě  yǐ lǜ ếü")).alias("r")).first()
    assert row.r == "keyilueu"


def test_unlisted_by_exams(seed):
    assert [(r.word, r.exam_count) for r in Q.unlisted_by_exams(seed).collect()] == [("机器猫", 1)]


def test_stored_corpus(spark, tmp_path):
    """Written and read back, both routes give the same, no text is read, and no table or column is missing."""
    files = spark.createDataFrame(
        [("e1", "reading", 3, "a b b c c c aa"), ("e1", "listening", 3, "b c"), ("e2", "reading", 4, "c d aa")],
        "exam_id string, source_type string, exam_level int, text string")
    wordlist = spark.createDataFrame([("a", "", 5, None, None), ("a", "", 2, None, None), ("b", "", 3, None, None)],
                                     "word string, pinyin string, word_level int, definition string, definition_th string")
    sources = spark.createDataFrame([("e1", "reading", 1, 3, "x"), ("e1", "listening", 1, 3, "y"), ("e2", "reading", 1, 4, "z")],
                                    "exam_id string, source_type string, year int, exam_level int, filename string")
    sentences = spark.createDataFrame([("e1", "reading", "a b b")], "exam_id string, source_type string, sentence string")
    K.write(K.build(files, wordlist, sources, sentences, rules=PLAIN_RULES), str(tmp_path))
    corpus = K.read(spark, str(tmp_path))
    rows = {r.word: r for r in Q.top_words(corpus).collect()}
    assert {w: (r.total_frequency, r.exam_count, r.word_level, r.effective_level) for w, r in rows.items()} == {
        "a": (1, 1, 2, 2), "b": (3, 1, 3, 3), "c": (5, 2, None, None), "aa": (2, 2, None, 2), "d": (1, 1, None, None)}
    live = {r.word: r for r in Q.top_words(corpus, exam_ids=["e1", "e2"]).collect()}
    for word, row in rows.items():
        assert (row.total_frequency, row.exam_count, row.effective_level, row.in_official_wordlist) == (
            live[word].total_frequency, live[word].exam_count, live[word].effective_level, live[word].in_official_wordlist)
    actual = checks.schema_rows(spark, {t: spark.read.parquet(K.table_paths(spark, str(tmp_path))[t]).columns for t in TABLES})
    assert checks.schema_drift(checks.schema_rows(spark, checks.expected_columns()), actual).count() == 0
    assert set(checks.constraint_violations(corpus.wordlist, *[getattr(corpus, n) for n in ("sources", "frequencies", "sentences")])
               .filter("violations > 0").toPandas()["check_name"]) == {"wordlist.word"}


def test_cleaned_converted_and_segmented(spark):
    """The whole way to counts for a script without blanks."""
    files = spark.createDataFrame(
        [("e1", "listening", 3, "他們去火車站,他們去火車站,很好。"), ("e1", "reading", 3, "火車站很大,很大。")],
        "exam_id string, source_type string, exam_level int, text string")
    pairs_ = spark.createDataFrame([("們", "们"), ("車", "车")], "source string, target string")
    lexicon = spark.createDataFrame([("他们", 9), ("火车站", 9), ("火车", 5), ("很", 9), ("去", 9)], "word string, weight long")
    ready = K.cleaned(files, F.col("source_type") == "listening", pairs_)
    wordlist = spark.createDataFrame([("火车站", 2)], "word string, word_level int")
    corpus = K.build(ready, wordlist, None, count=K.segmented_counts(lexicon))
    got = {(r.word, r.source_type): (r.frequency, r.word_level) for r in corpus.frequencies.collect()}
    assert got == {("他们", "listening"): (1, None), ("去", "listening"): (1, None), ("火车站", "listening"): (1, 2), ("很", "listening"): (1, None),
                   ("好", "listening"): (1, None), ("火车站", "reading"): (1, 2), ("很", "reading"): (2, None), ("大", "reading"): (2, None)}


def scanned_rows(df):
    """Rows that left the scans of a frame that has been collected."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan

    def leaves(node):
        if node.nodeName().endswith("QueryStage"):
            return leaves(node.plan())
        children = [node.children().apply(i) for i in range(node.children().size())]
        return [x for c in children for x in leaves(c)] if children else [node]

    return sum(n.metrics().apply("numOutputRows").value() for n in leaves(plan) if n.nodeName().startswith("Scan"))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A stored corpus of 120,000 counts and one sentence for every hundredth word."""
    folder = str(tmp_path_factory.mktemp("large") / "c")
    words = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    frequencies = words.select("word", F.lit(1).alias("word_level"), F.lit(1).alias("effective_level"), F.explode(F.array(F.lit("reading"), F.lit("listening"))).alias("source_type"),
                               F.lit("e1").alias("exam_id"), F.lit(2).cast("bigint").alias("frequency"), F.lit(True).alias("in_official_wordlist"))
    wordlist = words.select("word", F.lit("p").alias("pinyin"), F.lit(1).alias("word_level"), F.lit("d").alias("definition"), F.lit(None).cast("string").alias("definition_th"))
    sources = spark.createDataFrame([("e1", t, 2020, 3, "f") for t in ("reading", "listening")],
                                    "exam_id string, source_type string, year int, exam_level int, filename string")
    sentences = words.filter("word LIKE '%00'").select(F.lit("e1").alias("exam_id"), F.lit("reading").alias("source_type"), F.concat(F.lit("a sentence with "), "word").alias("sentence"))
    K.write(Corpus(wordlist, sources, frequencies, rollup(frequencies), sentences), folder)
    return folder


def test_a_look_up_reads_few_pages(spark, large):
    corpus = K.read(spark, large)
    rows = corpus.frequencies.filter("word = 'w4711'")
    assert len(rows.collect()) == 2 and scanned_rows(rows) <= 60_000
    assert corpus.frequencies.filter("word = 'w4711x'").count() == 0
    none = corpus.frequencies.filter("word = 'w4711x'")
    none.collect()
    # No row group's Bloom filter knows the word.
    assert scanned_rows(none) == 0


def test_a_load_leaves_no_shuffle_files(spark, tmp_path):
    def shuffles():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p.name for folder in folders for p in Path(folder).rglob("shuffle_*.data")}

    files = spark.createDataFrame([(f"m{i % 5}", "reading", 3, 2020, f"f{i}.pdf", f"Words and word{i} stand here. Number {i} is another line.") for i in range(40)],
                                  "exam_id string, source_type string, exam_level int, year int, filename string, text string")
    listed = spark.createDataFrame([("words", "w", 1, None, None)], "word string, pinyin string, word_level int, definition string, definition_th string")
    before = shuffles()
    built = K.build(files.repartition(4), listed, source_rows(files), K.sentences_of(files.repartition(4), ".", r"\p{L}", glued=False))
    K.write(built, str(tmp_path / "corpus"))
    # Spark deletes them behind the job.
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert K.read(spark, str(tmp_path / "corpus")).frequencies.filter("word = 'words'").count() == 5


def test_a_search_of_a_stored_corpus_uses_its_index(spark, large):
    corpus = K.read(spark, large)
    plain = replace(corpus, index=None)
    for query in ("w4700", "with w1", "w5", "no such sentence"):
        got, wanted = ({(r.exam_id, r.source_type, r.sentence) for r in Q.sentences_with(c, query).collect()} for c in (corpus, plain))
        assert got == wanted
    hit = Q.sentences_with(corpus, "w59900")
    assert len(hit.collect()) == 1 and scanned_rows(hit) < 60
    assert Q.word_detail(corpus, "w4700").first() == Q.word_detail(plain, "w4700").first()


def test_a_reader_keeps_its_version_of_all_tables(spark, large):
    before = K.read(spark, large)
    half = before.frequencies.filter("source_type = 'reading'").drop("created_at")
    number = K.write(Corpus(before.wordlist.drop("created_at"), before.sources.drop("processed_at"), half, rollup(half), None), large)
    after = K.read(spark, large)
    assert (before.frequencies.count(), after.frequencies.count()) == (120_000, 60_000) and after.sentences is None
    assert before.aggregates.filter("source_type = 'all'").first().total_frequency == 4
    assert K.read(spark, large, version=number - 1).frequencies.count() == 120_000
