import math
import random
import time

from lexfreq.operators import segmentation as G


def cuts(run):
    """All ways to cut a run."""
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in cuts(run[n:]):
            yield [run[:n], *rest]


def best(run, weights):
    total = sum(weights.values())

    def score(words):
        if any(len(w) > 1 and w not in weights for w in words):
            return -math.inf
        return sum(math.log(weights.get(w, 1)) - math.log(total) for w in words)
    return max(score(c) for c in cuts(run)), score


def test_paths_are_the_most_probable(spark):
    rng = random.Random(11)
    weights = {"".join(rng.choices("你好吗我们", k=rng.randint(1, 3))): rng.randint(1, 500) for _ in range(30)}
    lexicon = spark.createDataFrame(list(weights.items()), "word string, weight long")
    runs = {"".join(rng.choices("你好吗我们x", k=rng.randint(1, 9))) for _ in range(120)}
    frame = spark.createDataFrame([(r,) for r in runs], "run string").repartition(4)
    for most in (1000, 4):
        got = {r.run: r.words for r in G.segment_runs(frame, lexicon, most).collect()}
        assert set(got) == runs
        for run, words in got.items():
            top, score = best(run, weights)
            assert "".join(words) == run and abs(score(words) - top) < 1e-4


def test_time_follows_the_length(spark):
    """One run of 200,000 characters, cut by a list whose words cross no more than a few of them."""
    lexicon = spark.createDataFrame([("你好", 100), ("好吗", 50), ("我们", 70)], "word string, weight long")

    def seconds(n):
        run = "".join(random.Random(n).choices("你好吗我们x", k=n))
        start = time.perf_counter()
        row, = G.segment_runs(spark.createDataFrame([(run,)], "run string"), lexicon).collect()
        assert "".join(row.words) == run
        return time.perf_counter() - start

    seconds(1_000)
    short, long = seconds(20_000), seconds(200_000)
    assert long < 20 * short + 10


def test_counts_per_file(spark):
    files = spark.createDataFrame([("a", "你好你好"), ("b", "你好 abc"), ("c", ""), ("d", "123, xyz")], "file string, text string")
    lexicon = spark.createDataFrame([("你好", 100), ("你", 5), ("好", 5)], "word string, weight long")
    got = {(r.file, r.word): r.frequency for r in G.segmented_tokens(files, lexicon).collect()}
    assert got == {("a", "你好"): 2, ("b", "你好"): 1}


def test_longer_word_wins_a_tie_and_unknown_stays_single(spark):
    files = spark.createDataFrame([("a", "火车站很大")], "file string, text string")
    lexicon = spark.createDataFrame([("火车站", 9), ("火车", 9), ("站", 9), ("很", 9)], "word string, weight long")
    got = {r.word for r in G.segmented_tokens(files, lexicon).collect()}
    assert got == {"火车站", "很", "大"}


def test_no_list_and_no_runs(spark):
    lexicon = spark.createDataFrame([], "word string, weight long")
    runs = spark.createDataFrame([("你好",)], "run string")
    assert [r.words for r in G.segment_runs(runs, lexicon).collect()] == [["你", "好"]]
    assert G.segment_runs(runs.limit(0), spark.createDataFrame([("你", 1)], "word string, weight long")).collect() == []
