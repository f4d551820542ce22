import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lexfreq.llm import linear, quality, toxicity
from lexfreq.llm.deobfuscate import Restorer, _one_slot, character_counts, language_model

FOLDER = "/root/testdata/sf0.1"
supplied = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no supplied tables")


def area(score, label):
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for value in np.unique(score):
        same = score == value
        ranks[same] = ranks[same].mean()
    positive = label == 1
    return (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def held_out_rows(spark, found, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    assert len(rows) > 300
    return rows["score"].to_numpy(), rows["predicted"].to_numpy(), rows[label].to_numpy()


@supplied
def test_toxicity_on_held_out_labels(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    score, predicted, toxic = held_out_rows(spark, toxicity.toxicity(read("documents"), read("labels")), "toxic")
    assert area(score, toxic) > 0.97
    assert predicted[toxic == 1].mean() > 0.85 and predicted[toxic == 0].mean() < 0.02


@supplied
def test_quality_on_held_out_labels(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    score, predicted, good = held_out_rows(spark, quality.quality(read("documents"), read("labels")), "quality")
    assert area(score, good) > 0.9
    assert predicted[good == 1].mean() > 0.97


def test_machine_equals_the_sum_over_pairs():
    random = np.random.default_rng(1)
    part = pa.RecordBatch.from_arrays([pa.array(["a b a", "", None, "c " * 9]), pa.array([5.0, None, 2.0, 18.0])], ["text", "n_chars"])
    x = quality.inputs(part)
    n = (1 << quality.BUCKET_BITS) + len(quality.STATISTICS)
    m = quality.Machine(0.3, random.normal(size=n), random.normal(size=(n, 4)), np.zeros(n - (1 << quality.BUCKET_BITS)),
                        np.ones(n - (1 << quality.BUCKET_BITS)) * 5)
    got = m.score(x)
    for row in range(4):
        inputs = [(int(b), float(v)) for o, b, v in zip(x.owner, x.bucket, x.value) if o == row]
        inputs += [((1 << quality.BUCKET_BITS) + i, float(z)) for i, z in enumerate(m.standard(x.statistics)[row])]
        total = m.bias + sum(m.w[i] * v for i, v in inputs)
        total += sum(m.v[i] @ m.v[j] * v * u for k, (i, v) in enumerate(inputs) for j, u in inputs[k + 1:])
        assert got[row] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), rel=1e-9)


def test_regression_finds_the_telling_feature():
    rows = [np.array([0, 2]), np.array([1]), np.array([0]), np.array([1, 2])] * 20
    weights, bias = linear.fit(rows, np.array([1, 0, 1, 0] * 20), 3)
    assert weights[0] > 1 > -1 > weights[1] and abs(weights[2]) < 0.5
    assert linear.fit([], np.zeros(0), 0)[0].tolist() == []


@pytest.fixture(scope="module")
def restorer(spark):
    words = "the idiot and the moron are stupid worthless trash you loser clown scum pathetic disgusting to of is in on book look see all"
    docs = spark.createDataFrame([(words + " " + " ".join(reversed(words.split())),)] * 20, "text string")
    return Restorer(language_model(docs))


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"),
    ("id*ot", "idiot"), ("p4th3t1c", "pathetic"), ("c-l-o-w-n", "clown"), ("W0RTHLE55", "worthless"), ("boook", "book")])
def test_disguised_words_are_restored(restorer, seen, meant):
    texts, changed = restorer.restore(pa.array([f"The {seen} is in.", "plain text", None, ""]))
    assert texts.to_pylist() == [f"The {meant} is in." if seen[-1] != "." else "", "plain text", None, ""] and changed.tolist() == [1, 0, 0, 0]


def test_plain_texts_stay(restorer):
    texts = ["book and look, all of it!", "THE!! IDIOT!! OF!!", "moron$$$ stupid### trash***", "a | b | c", "on 12 the 3.", "é è à", "boo", "ok", "a!", "the"]
    assert restorer.restore(pa.array(texts))[0].to_pylist() == texts


def test_character_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("ab",)] * 7 + [(None,), ("",)], "text string").repartition(4)
    counted = {r.slot: r.n for r in character_counts(docs).collect()}
    for sequence in (b"a", b"b", b"ab", b" a", b" ab"):
        assert counted[_one_slot(int.from_bytes(sequence, "big"), len(sequence))] == 7


@pytest.mark.parametrize("module,label,fold", [(toxicity.toxicity, "toxic", (3, 1)), (quality.quality, "quality", (4, 2))])
def test_defined_cases(spark, module, label, fold):
    import zlib
    rows = [(1, None, 0), (1, None, 0), (2, "", 1), (None, "no id", 1), (3, "x" * 200_000, 5), (4, "bad words " * 30, 2), (5, "fine text\n" * 30, None)]
    docs = spark.createDataFrame([(i, t, n, 0.5, "q") for i, t, n in rows], "doc_id bigint, text string, n_chars bigint, score double, label string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (1, None), (None, 1), (2, 7)], f"doc_id bigint, {label} int")
    out = module(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 1)}) == 1
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    assert len(module(docs, none).collect()) == len(rows)
    assert module(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("only", [0, 1])
@pytest.mark.parametrize("module,label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_labels_of_one_kind(spark, module, label, only):
    docs = spark.createDataFrame([(i, f"a text with the words number {i}", 1) for i in range(8)], "doc_id bigint, text string, n_chars bigint")
    out = module(docs, spark.createDataFrame([(i, only) for i in range(8)], f"doc_id bigint, {label} int")).collect()
    assert len(out) == 8 and all((r.score > 0.5) == bool(only) for r in out)


def all_paths(restorer, span):
    """The smallest cost over every path of a lattice, and the letters of the paths that have it."""
    found = {}
    paths = [(0.0, b" ", b"")]
    for options in [*restorer._choices(span), [(b" ", 0.0)]]:
        longer = []
        for cost, state, letters in paths:
            for emitted, price in options:
                total, now = cost + price, state
                for char in emitted:
                    if char == 0x20 and now[-1] == 0x20:
                        continue
                    total += restorer._cost(now[-3:], char)
                    now += bytes([char])
                longer.append((total, now, letters + emitted))
        paths = longer
    for cost, _, letters in paths:
        found.setdefault(round(cost, 6), set()).add(" ".join(letters.decode().split()))
    return found[min(found)]


@pytest.mark.parametrize("span", ["1d10t", "id*ot", "i*i#t", "*#d10", "m0*0n", "a*!*b", "s.t.u", "$*u1d", "ooo*k", "(1*wn"])
def test_decoding_against_all_paths(restorer, span):
    """Both ways of decoding find a path that costs least among all."""
    best = all_paths(restorer, span)
    assert restorer._decoded(span) in best
    wide = restorer._decoded_wide([*restorer._choices(span), [(b" ", 0.0)]])
    assert " ".join(wide.decode().split()) in best


@pytest.mark.parametrize("word", ["z*#*#*#*#z*z", "z" + "*#%?" * 5000 + "z", "a*b#*c#*d#*e#*f", "a*" * 200 + "b", "1*" * 30 + "x"])
def test_masked_words_take_no_time(restorer, word):
    import time
    begin = time.process_time()
    texts, _ = restorer.restore(pa.array([word]))
    assert time.process_time() - begin < 1 and texts[0].as_py() is not None


def test_addresses_stay(restorer):
    texts = ["see https://ru.wikipedia.org/wiki/%D0%97%D0%B0 and www.m0r0n.example/1d10t there", "to ed.31@mail2.example.com, <a1b@x.org>",
             "key 3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1 or 4111111111111111a"]
    assert restorer.restore(pa.array(texts))[0].to_pylist() == texts


DISGUISES = {
    "look-alikes": lambda w, r: "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}.get(c, c) if r.random() < 0.8 else c for c in w),
    "separators": lambda w, r: r.choice(".-_*").join(w),
    "repeats": lambda w, r: (lambda i: w[:i] + w[i] * 3 + w[i + 1:])(r.randrange(len(w))),
    "mask": lambda w, r: (lambda i: w[:i] + "*" + w[i + 1:])(r.randrange(1, len(w) - 1)),
    "spaced": lambda w, r: " ".join(w),
}


@pytest.fixture(scope="module")
def disguised(spark):
    """Held-out toxic texts, the words that mark them among the texts learnt from, and how to score texts with and without restoration."""
    import re
    import zlib
    from collections import Counter
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    language = language_model(docs)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"), language)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    seen = {0: Counter(), 1: Counter()}
    held = []
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            held += [r.text] if r.toxic else []
        elif r.toxic in seen:
            seen[r.toxic].update(set(re.findall(r"[^\W\d_]{4,}", r.text.lower())))
    marks = {w for w, n in seen[1].items() if n >= 5 and n >= 3 * seen[0][w]}

    def found(texts):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(4)
        return {r.doc_id for r in toxicity.score(frame, language, model).filter("predicted = 1").collect()}

    held = [t for t in held if marks & set(re.findall(r"[^\W\d_]{4,}", t.lower()))]
    own = found(held)
    return [t for i, t in enumerate(held) if i in own], marks, found


@supplied
@pytest.mark.parametrize("kind", [*DISGUISES, "any"])
def test_disguised_toxic_words_are_found(disguised, kind):
    """Held-out texts that are found as they are, with every marking word disguised."""
    import random
    import re
    texts, marks, found = disguised
    rng = random.Random(1)

    def change(m):
        return m[0] if m[0].lower() not in marks else DISGUISES[kind if kind != "any" else rng.choice(sorted(DISGUISES))](m[0], rng)

    changed = [re.sub(r"[^\W\d_]{4,}", change, t) for t in texts]
    assert len(changed) > 50 and len(found(changed)) >= 0.85 * len(changed)
