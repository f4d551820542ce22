import numpy as np
import pytest

from lexfreq.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, every, k):
    """Brute force over the rows that take part."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - v)**2).sum())), j) for j, v in good if j != i)[:k]
            out[i] = near
    return out


def test_recall_and_scores(spark):
    random = np.random.default_rng(1)
    rows = [(int(i), random.normal(size=24).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    wanted, got = exact(rows, 50, 10), {}
    for r in ann.search(df, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    assert set(got) == set(wanted)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j in wanted[q]}) for q in wanted)
    assert hits / (10 * len(wanted)) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert [n for *_, n in near] == list(range(1, 11)) and [s for s, *_ in near] == sorted(s for s, *_ in near)
        for s, j, _ in near:
            assert s == pytest.approx(float(np.sqrt(((vectors[q] - vectors[j])**2).sum())), abs=1e-12)


def test_scan_gives_up_early_but_finds_the_nearest():
    random = np.random.default_rng(2)
    data = random.normal(size=(4000, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    missed = 0
    for q in random.normal(size=(20, 64)):
        ids, far = ann.scan(np.arange(4000), data, np.ascontiguousarray((data @ turn).T), q, q @ turn, -1, 10)
        real = np.sqrt(((data - q)**2).sum(axis=1))
        missed += len(set(np.argsort(real)[:10]) - set(ids))
        assert np.allclose(far, real[ids])
    assert missed <= 10


def test_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rows = [(i, [1.0, 2.0], 0) for i in range(300)] + [(300 + i, [float(i), 1.0], 0) for i in range(1, 60)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), every=100, share=1.0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 100] == [*range(10)]
    assert [r.vec_id for r in got if r.query_id == 0] == [*range(1, 11)]
    assert all(r.score == 0 for r in got if r.query_id in (0, 100, 200))


def test_rows_that_take_no_part(spark):
    bad = [(0, None, 1), (None, [1.0, 1.0], 1), (1, [0.0, 0.0], 1), (2, [float("nan"), 1.0], 1), (3, [1.0, None], 1),
           (4, [float("inf"), 1.0], 1), (5, [1.0], 1), (7, [], 1)]
    good = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [0.0, 1.0], 1), (102, [1.0, 1.0], 1)]
    df = spark.createDataFrame(bad + good, SCHEMA).selectExpr("*", "0 as list", "1 as score")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, every=100).collect()] == [
        (100, 1, 102, 1.0), (100, 2, 101, pytest.approx(2**0.5))]
    assert ann.search(spark.createDataFrame([], SCHEMA), every=100).collect() == []
    assert ann.search(spark.createDataFrame(bad, SCHEMA), every=100).count() == 0
