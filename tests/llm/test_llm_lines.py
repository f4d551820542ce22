import random

from lexfreq.llm import line_dedup

SCHEMA = "doc_id bigint, text string, pos int, lines string"


def by_definition(rows):
    """Later occurrences of three consecutive lines go; rows alike in doc_id and text are one document."""
    docs = sorted({(i is not None, i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1] or 0, d[2]))
    occurrences = {}
    for _, i, t in docs:
        lines = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")]
        for p in range(len(lines) - 2):
            if any(lines[p:p + 3]):
                occurrences.setdefault(tuple(lines[p:p + 3]), []).append((i, t, p))
    gone = set()
    for places in occurrences.values():
        first = min(places, key=lambda o: (o[0] is not None, o[0] or 0, o[2]))
        gone |= {(i, t, p + k) for i, t, p in places if (i, p) != (first[0], first[2]) or t != first[1] for k in range(3)}
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, t, p) not in gone)) for i, t in rows]


def test_against_the_definition(spark):
    draw = random.Random(6)
    lines = ["one", "two", " two ", "three\t", "", "four", "fünf", "six"]
    passage = "\n".join(f"passage {i}" for i in range(30))
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randint(0, 14)))) for i in range(80)]
    rows += [(100 + i, draw.choice(["", "head\n"]) + passage + f"\nown {i}") for i in range(200)]
    rows += [(500, passage), (500, passage), (501, None), (502, ""), (None, "a\nb\nc\nd"), (503, "x\na\nb\nc"), (504, "same\n" * 50), (505, "a\nb")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(by_definition(rows), key=repr)
    for r in got:
        if r.text is not None:
            kept = 0 if r.n_removed == r.n_lines else len(r.text.split("\n"))
            assert r.n_lines - r.n_removed == kept


def test_no_documents(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
