import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexfreq.operators import ngram_index as N

SENTENCES = "exam_id string, source_type string, sentence string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab %_\\你好é\U0001F600", k=rng.randint(1, 40))) for _ in range(300)] + ["xyz marks the spot", "xyz marks"]
    return sorted({(f"e{rng.randint(0, 5)}", rng.choice(["reading", "listening"]), rng.choice(texts)) for _ in range(900)}
                  | {("e1", "reading", t) for t in texts})


@pytest.fixture(scope="module", params=[N.BLOCK, 40])
def folder(request, spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    before, N.BLOCK = N.BLOCK, request.param
    N.write_index(spark.createDataFrame(rows, SENTENCES).repartition(3), path)
    yield path
    N.BLOCK = before


@pytest.mark.parametrize("asked", [N.ASKED, 2])
def test_searches_equal_a_scan(spark, rows, folder, asked, monkeypatch):
    monkeypatch.setattr(N, "ASKED", asked)
    for query in ("xyz marks", "a", "%_", "你好é", "ab ab", "\\你", "\U0001F600ab", "aaa", "not there at all", "spot"):
        got = sorted(tuple(r) for r in N.search(spark, folder, query).collect())
        assert got == [r for r in rows if query in r[2]], query


def test_a_search_reads_postings_and_hits_only(spark, rows, folder):
    """Of the texts only the blocks that hold candidates are read."""
    found = N.candidates(spark, folder, "xyz marks").collect()
    assert len(found) == 2
    plan = N.search(spark, folder, "xyz marks")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(place" in plan.replace(" ", "") or "place" in plan.split("PushedFilters")[1]
    files = {f for f in N.read_texts(spark, folder).filter(F.col("block").isin([r.block for r in found])).inputFiles()}
    assert len(files) <= len(N.read_texts(spark, folder).inputFiles())


def test_lists_are_sorted_and_whole(spark, rows, folder):
    import numpy as np
    postings = spark.read.parquet(f"{folder}/postings").collect()
    total = 0
    for r in postings:
        places = np.cumsum(np.frombuffer(bytes(r.gaps), "<u2").astype(int))
        assert (np.diff(places) > 0).all()
        total += len(places)
    assert total == sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for t in {r[2] for r in rows})


def test_no_sentences(spark, tmp_path):
    N.write_index(spark.createDataFrame([], SENTENCES), str(tmp_path / "i"))
    assert N.search(spark, str(tmp_path / "i"), "abc").collect() == N.search(spark, str(tmp_path / "i"), "a").collect() == []


def test_lists_of_a_block_are_sorted_as_two_columns(monkeypatch):
    """Pairs out of order and repeated give sorted lists, and rows of two numbers are not compared one by one."""
    unique = np.unique

    def of_one_column(values, axis=None):
        assert axis is None
        return unique(values)

    monkeypatch.setattr(np, "unique", of_one_column)
    draw = np.random.default_rng(1)
    gram, place = draw.integers(0, 300, 20_000), draw.integers(0, 1 << 8, 20_000)
    got = [(g, p) for b in N._lists(5, [gram[:400], gram[400:]], [place[:400], place[400:]]) for g, gaps in zip(b["gram"].to_pylist(), b["gaps"].to_pylist())
           for p in np.cumsum(np.frombuffer(gaps, "<u2").astype(np.int64)).tolist()]
    assert got == sorted(set(zip(gram.tolist(), place.tolist()))) and list(N._lists(5, [], [])) == []


def test_postings_of_a_full_block_take_little_memory():
    """Trigrams and places are sorted as one number for each posting, and the lists are those of the definition."""
    draw = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    sentences = ["".join(s) for s in letters[draw.integers(0, len(letters), (1 << 14, 40))]]
    sentences[5:8] = ["ab", "", "aaaaaa"]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(sentences[at:at + n])],
                                          ["block", "place", "sentence"]) for at in range(0, 1 << 14, 10_000) for n in [min(10_000, (1 << 14) - at)]]
    tracemalloc.start()
    found = list(N._postings(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {g: np.cumsum(np.frombuffer(gaps, "<u2").astype(int)).tolist()
           for b in found for g, gaps in zip(b["gram"].to_pylist(), b["gaps"].to_pylist())}
    wanted = {}
    for place, s in enumerate(sentences):
        for gram in N.query_trigrams(s):
            wanted.setdefault(gram, []).append(place)
    assert got == wanted and sum(b.num_rows for b in found) == len(wanted)
    assert peak < 40 * sum(map(len, wanted.values()))
