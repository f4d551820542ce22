"""Ranked search against its definition."""

import math
import random
import re

import pytest

from lexfreq.llm import ranked_search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, n int, item string, score double"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(text or "")]


def by_definition(docs, items, k=20):
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, w) for d, w in own if w]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        scores = []
        for d, w in own:
            m = 75 + 25 * len(w) * n_docs // n_terms
            score = 0
            for t in terms(text):
                tf = w.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **parameters):
    table = spark.createDataFrame([(*d, 1, "x", 0.5) for d in docs], SCHEMA).repartition(3)
    out = ranked_search.search(table, spark.createDataFrame([(*i, 1, "y") for i in items], "item_id bigint, text string, rank int, doc_id string"), **parameters)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n=400, size=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(size)]
    weights = [1 / (i + 1) for i in range(size)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_definition(spark, seed, monkeypatch):
    """Small trees, so that there are many; copies make equal scores."""
    monkeypatch.setattr(ranked_search, "TREE", 64)
    docs, items = corpus(seed)
    assert found(spark, docs, items) == by_definition(docs, items)


def test_blocks_of_items_and_whole_numbers(spark, monkeypatch):
    docs, items = corpus(7)
    wanted = by_definition(docs, items, 5)
    assert found(spark, docs, items, k=5, most_terms=40) == wanted
    monkeypatch.setattr(ranked_search, "EXACT", 0)
    assert found(spark, docs, items, k=5) == wanted


def test_odd_rows(spark):
    long = " ".join(f"long{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, "?! -"), (None, "same words here"), (4, "same words here"), (4, "same words here"), (None, "same"), (5, "SAME Words, ñandú"),
            (6, long), (7, "long7 " * 5000)]
    items = [(1, "same words"), (1, "same same"), (None, "ñandú long29999"), (2, None), (3, "..."), (4, "nothing of that"), (5, long)]
    assert found(spark, docs, items) == by_definition(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_pairs_of_nodes_are_dropped(spark, monkeypatch):
    """With thresholds in place most leaves are never scored, and the result is that of scoring all of them."""
    import numpy as np

    rng = random.Random(3)
    docs = [(i, " ".join(f"t{i % 40}x{rng.randint(0, 30)}" for _ in range(20))) for i in range(2000)]
    items = {0: "t3x1 t3x2 t3x3 t3x4"}
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, d in docs for t in terms(d)}))}
    weight = np.full(len(vocabulary), 1000)
    stored = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    rows = ranked_search.trees(ranked_search.vectors(stored, vocabulary), 2000, 40_000, weight).collect()
    block = ranked_search.Block([(0, 0, {t: 1 for t in terms(items[0])})], vocabulary, weight)
    scored = total = 0
    for r in rows:
        tree = ranked_search.Tree(np.array(r.numbers), np.array(r.impacts), np.array(r.offsets), len(vocabulary), np.float64)
        best = ranked_search.Best(np.zeros(1, np.int64), 20)
        list(ranked_search._search(tree, block, best, False))
        taken = []
        monkeypatch.setattr(best, "take", lambda item, scores: taken.append(len(scores)))
        leaves = sum(1 for _ in ranked_search._search(tree, block, best, False))
        scored, total = scored + leaves, total + len(tree.levels.maxima[0])
    assert 0 < scored <= total / 4
