import random
import re

from pyspark.sql import functions as F

from lexfreq.llm.decontaminate import covered, decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string, n_words int, spans string", "item_id bigint, text string, slot int"


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_definition(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        out.append((d, len(w), len(hit), sorted(i for i in found if i is not None)))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    rows = decontaminate(d, b, **options).select("doc_id", "n_words", covered(F.col("spans")).alias("n"), F.array_sort("item_ids").alias("ids"))
    return [(r.doc_id, r.n_words, r.n, r.ids) for r in rows.collect()]


def test_against_the_definition(spark):
    draw = random.Random(7)
    vocabulary = ["a", "b", "C", "dé", "日", "9x"]
    items = [(i, " ".join(draw.choices(vocabulary + ["long"], k=draw.choice([3, 5, 9, 10, 11, 24])))) for i in range(30)]
    items += [(40, None), (41, "..!"), (None, "unnamed item of six words here"), (42, "solo")]
    docs = []
    for d in range(200):
        parts = draw.choices(vocabulary, k=draw.randint(0, 40))
        if draw.random() < 0.5:
            source = words(draw.choice(items)[1])
            cut = draw.randint(0, max(0, len(source) - 4))
            parts[draw.randint(0, len(parts)):0] = source[cut:cut + draw.randint(4, 24)]
        docs.append((d, draw.choice([" ", ", ", "\n"]).join(parts).upper()))
    docs += [(7, "solo"), (7, "solo"), (None, "Solo!"), (300, None), (301, ""), (302, "x " * 5000 + "unnamed item of six words here")]
    wanted = by_definition(docs, items)
    assert any(n for _, _, n, _ in wanted) and any(not n for _, _, n, _ in wanted)
    assert sorted(run(spark, docs, items), key=repr) == sorted(wanted, key=repr)
    # A bit table that lets nearly everything pass changes nothing.
    assert sorted(run(spark, docs, items, bits=4), key=repr) == sorted(wanted, key=repr)


def test_every_long_shared_span_is_found(spark):
    draw = random.Random(8)
    item = [f"w{draw.randint(0, 50)}" for _ in range(400)]
    docs = [(s, " ".join(["zz"] * (s % 13) + item[s:s + 10] + ["yy"] * (s % 7))) for s in range(390)]
    got = run(spark, docs, [(1, " ".join(item))])
    assert all(n >= 10 and ids == [1] for _, _, n, ids in got)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_words_that_agree_in_polynomial_hashes(spark):
    """The Thue-Morse word and its complement have the same value of any polynomial modulo 2^64 with an odd base."""
    word, other = ("".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1))
    docs = spark.createDataFrame([(1, " ".join([word] * 12)), (2, " ".join([other] * 12))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join([word] * 10)), (2, word)], "item_id bigint, text string")
    assert {r.doc_id: len(r.item_ids) for r in decontaminate(docs, items).collect()} == {1: 2, 2: 0}
