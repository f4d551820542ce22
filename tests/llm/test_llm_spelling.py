"""Spelling variants against their definition."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexfreq.llm import queries, spelling

SCHEMA = "doc_id bigint, text string, word string, n int, key string"


def counted(rows, least=7, deleted=31):
    out = {}
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % deleted == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                out[word] = out.get(word, 0) + 1
    return {w: n for w, n in out.items() if n >= 2}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}) - {word}


def by_definition(rows, **parameters):
    words = counted(rows, **parameters)
    alphabet = set("".join(words))
    near = {w: [x for x in edits(w, alphabet) if x in words] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words.get(forms[w])))
    return sorted(out)


def found(spark, rows, **parameters):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    out = spelling.variants(docs, **parameters)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("letters", ["ab", "abcñé", "abcdefghijklmnopqrstuvwxyzñÀ÷"])
def test_against_definition(spark, letters):
    """Words of few and of many letters (so of few and many equal bigrams), some of them edited, some of them frequent enough to be forms."""
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(60)]
    base += ["".join(rng.choice(letters[:2]) for _ in range(rng.randint(7, 9))) for _ in range(60)]
    base += [rng.choice(sorted(edits(w, letters))) for w in base for _ in range(3)]
    text = [w for w in base for _ in range(rng.choice([1, 2, 2, 3, 25, 260]))]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::40])) for i in range(40)]
    rows = [(i, t.upper() if i % 3 == 0 and letters.isascii() else t) for i, t in rows]
    got = found(spark, rows)
    assert got == by_definition(rows)
    assert any(r[4] > 1 for r in got) and any(r[1] for r in got)


def test_chains_of_forms(spark):
    chain = ["alphabet" + "x" * i for i in range(5)]
    rows = [(None, " ".join(w for i, w in enumerate(chain) for _ in range(2 * 11**(4 - i))))]
    got = {r[0]: r for r in found(spark, rows)}
    assert all(got[w][2] == chain[0] for w in chain) and got[chain[4]][1] == chain[3]


def test_odd_documents(spark):
    long = "ab" * 20_000
    rows = [(1, None), (2, ""), (None, "Straßen straßen STRAßEN Ünlike ünlikely ünlikely"), (3, f"{long} {long}c {long} {long}c"), (4, "a" * 300 + " " + "a" * 301), (5, "a" * 300 + " " + "a" * 301),
            (3, "repeated repeated"), (3, "repeated repeated"), (6, "1234567 日本語日本語日本語 日本語日本語日本語 don't dön't"), (7, "×××××××÷ ×××××××÷ ×××××××"), (8, "×××××××")]
    wanted = by_definition([r for r in rows if long not in (r[1] or "")])
    got = found(spark, rows)
    assert [r for r in got if len(r[0]) < 1000] == wanted
    assert {len(r[0]): r[4] for r in got if len(r[0]) > 1000}.keys() <= {39_999, 40_000, 40_001}
    assert found(spark, []) == []


def test_checksums_of_strings_one_behind_the_other():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.randint(0, 64))) for _ in range(500)]
    got = spelling.behind(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([zlib.crc32(b) for _, b in pairs], np.uint32),
                          np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(3, 9) for _ in range(6)]
        word = np.repeat(np.arange(6), sizes)
        at = np.concatenate([np.sort(rng.sample(range(12), n)) for n in sizes])
        cost = np.array([rng.randint(1, 20) for _ in at])
        left, right = spelling._pivots(word, at, cost, 6)
        for w in range(6):
            own = np.flatnonzero(word == w)
            best = min(cost[i] + cost[j] for i in own for j in own if at[j] - at[i] > 1)
            assert cost[left[w]] + cost[right[w]] == best and at[right[w]] - at[left[w]] > 1


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_spelling_variants(spark, folder).collect()) == by_definition(rows)


def test_runs_are_those_of_the_pattern():
    texts = ["ab cd", "Ãé×÷x", "日本ab語", "", None, "aÿĀb", "é"]
    words = spelling.find_runs(pa.array(texts))
    got = [words.data[b:e].tobytes().decode() for b, e in zip(words.begin, words.end)]
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert got == [w for t in lowered for w in re.findall("[a-zÀ-ÿ]+", t)]
