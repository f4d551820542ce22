"""Extra columns whose names the operators use themselves."""

import pytest

from lexfreq.llm import line_dedup, pii, toxicity
from lexfreq.llm.deobfuscate import language_model
from lexfreq.llm.scratch import fresh

PASSAGE = "first line\nsecond line\nthird line"
ROWS = [(1, f"Mail to mary.jones@example.org or call +49 30 1234567.\n{PASSAGE}"), (2, f"{PASSAGE}\nand more"), (3, None), (3, ""), (None, "x" * 20_000)]


def run(spark, name, docs):
    if name == "lines":
        return line_dedup.dedup_lines(docs)
    if name == "pii":
        return pii.replace(docs)
    plain = docs.select("doc_id", "text")
    language = language_model(plain)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    return toxicity.score(docs, language, toxicity.train(plain, labels, language))


ADDED = {"lines": ["n_lines", "n_removed"], "pii": ["n_replaced"], "toxicity": ["score", "n_restored", "predicted"]}
OWN = {"lines": ["_lines", "_gone", "_starts", "_id", "_KEY", "__id", "pos", "h1"], "pii": ["_later", "__LATER", "_id", "_key", "kind", "made"],
       "toxicity": ["label", "features", "others", "slot"]}


@pytest.mark.parametrize("name", ADDED)
def test_clashing_columns_stay_and_results_are_the_same(spark, name):
    plain = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    extra = OWN[name] + ADDED[name]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in extra)
    clashing = spark.createDataFrame([(*row, *(f"{c} of {row[0]}" for c in extra)) for row in ROWS], schema)
    out = run(spark, name, clashing)
    assert out.columns == ["doc_id", "text", *OWN[name], *ADDED[name]]
    expected = run(spark, name, plain)
    assert sorted(map(tuple, out.select(*expected.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    for row in out.collect():
        assert all(row[c] == f"{c} of {row.doc_id}" for c in OWN[name])
    assert run(spark, name, clashing.limit(0)).collect() == []


def test_free_names():
    assert fresh(["a", "_B", "__b"], "_b", "_c", "_c") == ["___b", "_c", "__c"]
