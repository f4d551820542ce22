import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexfreq.llm import simhash
from lexfreq.llm.components import components

SCHEMA = "doc_id bigint, text string, fingerprint int, fp string"


def by_definition(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É é à ß", "x " * 2000,
                                  " ".join(random.Random(1).choices("abcdefgh", k=900))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_definition(text)


def test_fingerprint_uses_the_hash_of_spark(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (2**64 - 1) == simhash.fingerprint("A b\tC")


def test_links_join_all_pairs_within_three_bits(spark):
    draw = random.Random(2)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        centre = draw.getrandbits(64)
        fps.add(centre)
        for _ in range(draw.randint(0, 12)):
            near = centre
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                near ^= 1 << bit
            fps.add(near)
            centre = draw.choice([centre, near])
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3)
    found = simhash.links(df, len(fps))
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in found.collect())
    got = {r.node: r.root for r in components(found).collect()}
    wanted = reachable(pairs, signed)
    linked = {n for p in pairs for n in p}
    assert set(got) == linked
    assert {n: wanted[n] for n in linked} == reachable([(n, r) for n, r in got.items()], linked) or all(
        (wanted[a] == wanted[b]) == (got[a] == got[b]) for a in linked for b in linked)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 200)]
    pairs = chain + star + [(500, 501), (501, 502), (502, 500), (7, 7)]
    random.Random(3).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == reachable(pairs, {n for a, b in pairs for n in (a, b)})
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates(spark):
    base = " ".join(random.Random(4).choices([f"w{i}" for i in range(300)], k=800))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (None, base), (8, None), (2, " "), (11, "other words here"), (11, "other words here")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 9: 3, None: 3, 8: 2, 2: 2, 11: 11}
    assert {r.fingerprint for r in got if r.doc_id in (8, 2)} == {"0" * 16}
    assert {r.fingerprint for r in got if r.doc_id == 11} == {f"{by_definition('other words here'):016x}"}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_similar_documents(spark):
    draw = random.Random(5)
    rows = []
    for family in range(60):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([6, 60, 300, 900]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(draw.randint(0, 6)):
            words = [w if draw.random() > draw.choice([0, 0.005, 0.02, 0.1]) else "changed" for w in base]
            rows.append((len(rows), draw.choice([" ", "\n"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words"), (None, rows[0][1]), (2, rows[2][1])]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    out = simhash.similar_documents(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out}
    sets = {i: shingles(t) for i, t in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(1000) if a in sets for b in range(a) if b in sets}
    near = [p for p, j in like.items() if j >= 0.85]
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    loose = reachable([p for p, j in like.items() if j >= 0.8], [i for i in sets if i is not None])
    assert all(loose[i] == loose[got[i]] for i in range(len(rows) - 6))
    assert got[1000] == got[1001] == 1000 and got[1002] == got[1003] == 1002 and got[None] == got[0]
    assert simhash.similar_documents(df.limit(0)).collect() == []


def test_copies_of_one_original_that_are_not_similar_to_each_other(spark):
    """Copies are at 0.85 to 0.88 of the original and at about 0.73 of one another, so only the original joins them."""
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(260)]
    rows = [(2000, " ".join(base))]
    for i in range(1000):
        words = list(base)
        for block in draw.sample(range(52), 4):
            words[block * 5 + 2] = f"new{i}x{block}"
        rows.append((i, " ".join(words)))
    own = shingles(rows[0][1])
    like = [len(own & s) / len(own | s) for s in (shingles(t) for _, t in rows[1:])]
    assert 0.84 < min(like) and max(like) < 0.89
    sets = [shingles(t) for _, t in rows[1:200]]
    assert sum(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i]) < 0.1 * 199 * 99
    # Intruders that have a good part of the text, but not enough of it.
    for i in range(200):
        rows.append((3000 + i, " ".join(base[:205] + [f"other{i}x{k}" for k in range(55)])))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert sum(got[i] == 0 for i in range(1000)) == 1000 and got[2000] == 0
    assert all(got[i] == i for i in range(3000, 3200))


def test_lone_pairs_at_the_threshold(spark):
    """Pairs at 0.8 or just above without any other partner, in long texts and in texts of eight and nine words."""
    draw = random.Random(7)
    rows, below = [], set()
    for pair in range(600):
        words = [f"p{pair}w{draw.randint(0, 10**6)}" for _ in range(8 if pair % 2 else 204)]
        other = [*words, "more"]
        if not pair % 2:
            # Each change takes five of 200 shingles and puts in five others: 180 of 220 in common; one change more is below 0.8.
            other = list(words)
            for block in range(5 if pair % 20 == 0 else 4):
                other[20 + 30 * block] = f"changed{block}"
            if pair % 20 == 0:
                below.add(pair)
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    sets = [shingles(t) for _, t in rows]
    for pair in range(600):
        a, b = sets[2 * pair], sets[2 * pair + 1]
        assert (len(a & b) * 5 >= len(a | b) * 4) == (pair not in below)
        assert got[2 * pair] == 2 * pair and got[2 * pair + 1] == 2 * pair + (pair in below)


@pytest.mark.parametrize("frequent,chunk", [(2.0**-13, 1 << 16), (0.1, 50), (0.3, 7), (2.0, 1 << 16)])
def test_texts_that_share_a_band(spark, monkeypatch, frequent, chunk):
    """A band that a third of all texts share, one of two texts, and many of one text, whichever bands count as frequent."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = random.Random(5)
    rows = [(i, [1_000_000 + draw.randrange(3000), draw.randrange(20), -7 if i % 3 == 0 else i + 100]) for i in range(600)]
    rows += [(600, [2_000_000]), (601, [2_000_000]), (602, [])]
    df = spark.createDataFrame(rows, "number bigint, bands array<bigint>").repartition(5)
    members = {}
    for number, bands in rows:
        for band in bands:
            members.setdefault(band, set()).add(number)
    wanted = sorted((band, n) for band, numbers in members.items() if len(numbers) > 1 for n in numbers)
    assert sorted(map(tuple, simhash._groups(df, len(rows)).collect())) == wanted
    found = simhash._frequent(df, len(rows)).tolist()
    assert found == sorted(found) and all(len(members[b]) >= max(2, frequent * len(rows)) for b in found)
    assert {b for b, numbers in members.items() if len(numbers) >= 2 * frequent * len(rows) + 5} <= set(found) or frequent < 0.01
    assert simhash._groups(df.limit(0), 0).collect() == []


def test_pairs_ruled_out_are_not_similar(spark):
    """Pairs of sets around the threshold, exactly on it too: by their sizes and parities only pairs below it may be ruled out."""
    draw = random.Random(8)
    rows = []
    for n in [1, 2, 5, 9, 90, 450, 900, 9000]:
        for share in (0.5, 0.75, 0.79, 8 / 9, 8 / 9 - 1 / n, 8 / 9 + 1 / n, 1):
            common = max(0, min(n, round(n * share)))
            same = draw.sample(range(1 << 60), common)
            sides = [np.array(sorted(same + draw.sample(range(1 << 60, 1 << 61), n - common)), np.uint64) for _ in range(2)]
            a, b = (set(s.tolist()) for s in sides)
            rows.append((len(a), simhash._parities(sides[0]).tolist(), len(b), simhash._parities(sides[1]).tolist(), 5 * len(a & b) >= 4 * len(a | b)))
    df = spark.createDataFrame(rows, "m bigint, p array<bigint>, n bigint, q array<bigint>, similar boolean")
    got = df.select("similar", "n", simhash._may_be_similar("m", "p", "n", "q", 0.8).alias("kept")).collect()
    assert any(r.similar for r in got) and all(r.kept for r in got if r.similar)
    assert sum(not r.kept for r in got if not r.similar) > 8


def test_possible_texts(spark, monkeypatch):
    """All rows of the texts asked for come through, and hardly others; none for no texts; with few places still all."""
    rows = [(i % 7 if i % 5 else None, f"text {i // 2}" if i % 11 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key")).filter("doc_id = 3 OR doc_id IS NULL")
    wanted = sorted(map(str, (r for r in rows if r[0] in (3, None))))
    assert sorted(str((r.doc_id, r.text)) for r in simhash._possible(docs, texts).collect()) == wanted
    assert simhash._possible(docs, texts.limit(0)).collect() == []
    monkeypatch.setattr(simhash, "PLACES", 1 << 15)
    assert {str((r.doc_id, r.text)) for r in simhash._possible(docs, texts).collect()} >= set(wanted)


def test_similar_documents_come_from_fingerprints(spark, monkeypatch):
    """Texts at 3 bits or fewer are found by ball hashing, without any band, and checked by their shingles."""
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(f"v{w}" for w in base)), (4, None), (5, "")]
    one, two, other = (simhash.fingerprint(t) for _, t in rows[:3])
    assert 0 < (one ^ two).bit_count() <= 3 < (one ^ other).bit_count()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    monkeypatch.setattr(simhash, "_groups", lambda distinct, count: distinct.select(distinct["number"].alias("bucket"), "number").limit(0))
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    # What the fingerprints join is checked: copies of another text that only seem to be near are let go.
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle=3: 7)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_a_group_with_few_others_takes_few_rounds(spark, monkeypatch):
    """A bucket of one large component and some texts that are not similar to it, two of them to each other, is finished in the second round."""
    draw = np.random.default_rng(9)
    base = draw.integers(0, 1 << 62, 200)
    sets = [np.append(base[:195], draw.integers(0, 1 << 62, 5)) for _ in range(250)]
    # Half of the text, so that sizes and parities do not tell all of these apart, and the rest of their own.
    sets += [np.append(base[:100], draw.integers(0, 1 << 62, 100)) for _ in range(20)]
    sets.append(np.append(sets[-1][:190], draw.integers(0, 1 << 62, 10)))
    rows = [(i, s.tolist(), simhash._parities(s.astype(np.uint64)).tolist()) for i, s in enumerate(sets)]
    texts = spark.createDataFrame(rows, "number bigint, shingles array<bigint>, parities array<bigint>").repartition(4)
    sizes = texts.select("number", F.size("shingles").cast("bigint").alias("size"), F.lit(271).cast("bigint").alias("reach"))
    groups = texts.select(F.lit(1).cast("bigint").alias("bucket"), "number")
    rounds, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: rounds.append(name) or write(df, name))
    got = {r.node: r.root for r in simhash._joined(groups, sizes, texts, 0.8).collect()}
    assert {i: got.get(i, i) for i in range(len(sets))} == {i: 0 if i < 250 else 269 if i == 270 else i for i in range(len(sets))}
    assert rounds.count("open_groups") <= 3
