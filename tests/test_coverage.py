import pytest

from lexfreq.operators import labels as L
from lexfreq.plans import analysis as A, coverage as V

LISTED = {"我": 1, "你": 1, "干净": 3, "很": 2, "多": 1, "看": 2}
ROWS = [("我", "e1", "reading", 3, 5), ("我", "e2", "listening", 4, 2), ("干干净净", "e1", "reading", 3, 1),
        ("很多", "e1", "reading", 3, 2), ("很多", "e2", "reading", 4, 1), ("猫猫狗", "e1", "reading", 3, 2),
        ("你我", "e2", "listening", 4, 3), ("问号", "e1", "reading", 3, 1), ("问号", "e2", "reading", 4, 1)]


@pytest.fixture(scope="module")
def wordlist(spark):
    return spark.createDataFrame(list(LISTED.items()), "word string, word_level int")


@pytest.fixture(scope="module")
def counts(spark, wordlist):
    rows = spark.createDataFrame(ROWS, "word string, exam_id string, source_type string, exam_level int, frequency long")
    return L.label_counts_in_full(rows, wordlist).cache()


@pytest.fixture(scope="module")
def review(spark, counts, wordlist):
    one = spark.createDataFrame([("猫猫狗",), ("问号",)], "word string")
    return L.unmatched_review(counts, wordlist, one, one.filter("word = '问号'")).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_labels(counts):
    got = {r.word: (r.word_level, r.effective_level, r.match_type, r.match_pattern) for r in counts.collect()}
    assert got == {"我": (1, 1, "direct", None), "干干净净": (None, 3, "decomposed", "aabb_reduplication"),
                   "很多": (None, 2, "decomposed", "function_prefix"), "猫猫狗": (None, None, "unmatched", None),
                   "你我": (None, 1, "decomposed", "pronoun_prefix"), "问号": (None, None, "unmatched", None)}
    assert counts.count() == len(ROWS)


def test_coverage(counts):
    assert rows(V.match_share(counts)) == [(2, 9, 7, 18, 2 / 9, 7 / 18)]
    assert rows(V.by_match_type(counts)) == [
        ("direct", 1, 7, 1 / 6, 7 / 18), ("decomposed", 3, 7, 3 / 6, 7 / 18), ("unmatched", 2, 4, 2 / 6, 4 / 18)]
    assert rows(V.by_level(counts)) == [("L1", 2, 10), ("L2", 1, 3), ("L3", 1, 1), ("L4", 0, 0), ("L5", 0, 0), ("L6", 0, 0),
                                        (L.NOT_LISTED, 2, 4)]
    assert rows(V.by_exam_level(counts)) == [(3, 3, 2, 8, 3), (4, 3, 1, 6, 1)]
    assert rows(V.level_by_exam_level(counts, (3, 4)))[:2] == [("L1", 5, 5, 0), ("L2", 2, 1, 0)]
    assert rows(V.level_by_exam_level(counts, (3, 4), measure="words"))[0] == ("L1", 1, 2, 0)
    assert rows(V.funnel(counts)) == [(1, "direct", 7, 7 / 18), (2, "direct and decomposed", 14, 14 / 18)]
    assert rows(V.pattern_counts(counts)) == [("aabb_reduplication", 1, 1), ("function_prefix", 1, 3), ("pronoun_prefix", 1, 3)]
    assert [r.word for r in V.decomposed_examples(counts, 2).collect()] == ["你我", "很多"]
    assert rows(V.top_unmatched(counts)) == [("猫猫狗", 2), ("问号", 2)]


def test_no_match_is_no_error(spark, counts):
    assert rows(V.by_match_type(counts.filter("false")))[0] == ("direct", 0, 0, None, None)


def test_review(review):
    got = {r.word: r.asDict() for r in review.collect()}
    assert got["猫猫狗"] == {"word": "猫猫狗", "total_count": 2, "exam_count": 1, "exam_levels_seen": "3",
                          "source_types_seen": "reading", "char_length": 3, "likely_noise": True,
                          "all_chars_known": False, "in_segmenter_dict": True, "in_dictionary": False}
    assert got["问号"]["exam_levels_seen"] == "3,4" and not got["问号"]["likely_noise"]
    assert [r.word for r in V.dictionary_confirmed(review).collect()] == ["问号"]
    assert V.triple_signal_noise(review).count() == 0 and V.rescued_words(review).count() == 0
    assert rows(V.review_flags(review)) == [(2, 1, 2, 1)]


def test_heuristics(review):
    got = {r.heuristic: (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1, r.accuracy) for r in V.heuristic_quality(review).collect()}
    assert got == {"not likely_noise": (1, 0, 0, 1, 1.0, 1.0, 1.0, 1.0), "in_segmenter_dict": (1, 1, 0, 0, .5, 1.0, 2 / 3, .5)}
    empty = V.heuristic_quality(review.filter("false")).collect()
    assert {(r.precision, r.f1, r.accuracy) for r in empty} == {(None, None, None)}


def test_strongest_candidates_and_known_characters(spark, wordlist):
    words = spark.createDataFrame([("我多", 9), ("我猫", 9)], "word string, n int")
    assert {tuple(r) for r in L.characters_known(words, wordlist).collect()} == {("我多", 9, True), ("我猫", 9, False)}


def test_sample_is_repeatable(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(200)], "word string")
    picks = [rows(V.repeatable_sample(words.repartition(n))) for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 15


def test_rankings(counts, wordlist):
    assert [(r.word, r.total_count) for r in A.top_overall(counts, 2).collect()] == [("我", 7), ("你我", 3)]
    assert rows(A.top_word_per_file(counts)) == [("e1", "reading", 3, "我", 5), ("e2", "listening", 4, "你我", 3), ("e2", "reading", 4, "很多", 1)]
    summary = A.top_summary(counts).collect()
    assert len(summary) == 6 and tuple(summary[0]) == ("我", 7, 2, 1, "direct")
    ranked = {r.rank: (r.total_count, r.ideal_count) for r in A.rank_frequency(counts).collect()}
    assert ranked[1] == (7, 7.0) and ranked[4] == (2, 7 / 4) and len(ranked) == 6
    assert {(r.effective_level, r.word) for r in A.top_per(counts, "effective_level", 1).collect()} == {(1, "我"), (2, "很多"), (3, "干干净净")}
    assert {tuple(r) for r in A.heat_map(counts, 1).collect()} == {("我", "e1", 5), ("我", "e2", 2)}
    assert rows(A.heat_map_matrix(counts, ["e1", "e2", "e3"], 1)) == [("我", 5, 2, 0, 0)]
    assert rows(A.heat_map_matrix(counts, ["e2"], 1)) == [("我", 2, 5)]


def test_list_against_seen(counts, wordlist):
    assert rows(A.list_size_against_seen(wordlist, counts)) == [(1, 3, 2), (2, 2, 1), (3, 1, 1)]
    assert [r.word_level for r in A.missing_levels(wordlist).collect()] == [4, 5, 6, 7, 8, 9]
    assert rows(A.words_per_level(wordlist)) == [(1, 3), (2, 2), (3, 1)]


def test_levels_beyond_the_list_and_other_papers_are_kept(spark):
    wordlist = spark.createDataFrame([("a", 8), ("b", 2)], "word string, word_level int")
    counts = spark.createDataFrame([("a", "e1", "reading", 3, 5), ("a", "e2", "reading", 7, 2), ("b", "e3", "reading", None, 1), ("a", "e4", "reading", 9, 4)],
                                   "word string, exam_id string, source_type string, exam_level int, frequency long")
    labelled = L.label_counts_in_full(counts, wordlist)
    assert rows(V.by_level(labelled)) == [("L1", 0, 0), ("L2", 1, 1), *[(f"L{n}", 0, 0) for n in (3, 4, 5, 6)], ("L8", 1, 11), (L.NOT_LISTED, 0, 0)]
    assert rows(V.level_by_exam_level(labelled, (3, 4)))[6:] == [("L8", 5, 0, 6), (L.NOT_LISTED, 0, 0, 0)]
    assert rows(V.level_by_exam_level(labelled, (3, 4), measure="words"))[6] == ("L8", 1, 0, 1)
