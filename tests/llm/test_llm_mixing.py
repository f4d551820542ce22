import heapq
import random
import re

import pytest

from lexfreq.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(votes, seats):
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    return out


def test_apportion_is_one_seat_after_the_other():
    draw = random.Random(3)
    for _ in range(200):
        votes = [draw.choice([0, draw.random(), draw.random() * 50]) for _ in range(draw.randint(1, 9))]
        seats = draw.randint(0, 60)
        assert mixing.apportion(votes, seats) == highest_quotients(votes, seats)


def test_apportioned_in_groups(spark):
    draw = random.Random(4)
    rows, wanted = [], {}
    for group in [*"abc", None]:
        votes, seats = [draw.randint(0, 400) for _ in range(draw.randint(1, 12))], draw.randint(0, 90)
        rows += [(group, i, v, seats) for i, v in enumerate(votes)]
        wanted |= {(group, i): n for i, n in enumerate(highest_quotients(votes, seats))}
    df = spark.createDataFrame(rows, "g string, i bigint, votes bigint, seats bigint")
    got = mixing.apportioned(df, ["g"], "i", "votes", "seats", "won").collect()
    assert {(r.g, r.i): r.won for r in got} == wanted


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([100, 100], [1, 3]) == [50, 150]
    assert mixing.targets([10, 1000, 0], [5, 1, 1]) == [30, 980, 0]
    goal = mixing.targets([1, 2, 300, 40], [1, 2, 3, 1])
    assert sum(goal) == pytest.approx(343) and all(g <= 3 * n + 1e-9 for g, n in zip(goal, [1, 2, 300, 40]))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 7, 60, 900])), draw.choice(["a", "b", "b", "b", "é", None]), i, "x")
            for i in range(500)]
    rows += [(7, "twice the same", "a", 1, "x")] * 2 + [(None, "\tno id \n here", "b", 2, "x"), (501, None, "b", 3, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in docs.collect():
        size.setdefault(r.source, []).append(len(WORDS.findall(r.text or "")))
    names = ["a", "b", "é", None]
    goal = dict(zip(names, mixing.targets([sum(size[n]) for n in names], [1, 2, 3, 1])))
    for name in names:
        own = [r for r in rows if r.source == name]
        assert sorted(r["size"] for r in own) == sorted(size[name])
        assert {r.source_size for r in own} == {sum(size[name])} and {r.target for r in own} == {goal[name]}
        assert sum(r.taken for r in own) == pytest.approx(goal[name], rel=0.01)
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
    assert rows == mixing.mix(docs.repartition(5)).collect() or sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_small_shards_and_groups_add_up(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    rows = mixing.mix(docs).collect()
    for name in {r.source for r in rows}:
        own = [r for r in rows if r.source == name]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)


def test_mixed_documents_hold_the_words_taken(spark, docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.row.doc_id] = taken.get(r.row.doc_id, 0) + r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    held = {}
    for r in out.collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + len(WORDS.findall(r.text or ""))
    assert {k: v for k, v in held.items() if v} == {k: v for k, v in taken.items() if v}


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).collect() == []
    wordless = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(wordless).collect()] == [(0, 0.0, 0)] * 2
