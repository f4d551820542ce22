import re

import pytest

from lexfreq.llm import pii

TEXT = ("Mr. John Smith <john.smith@mail7.example.com> called +1 (017) 555-7713 from 97.51.17.173; card 4111 1111 1111 1111, again 4111111111111111, "
        "account 9807915762804490, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", number 123-45-6789, DE44 5001 0517 5407 3249 31.\nMrs Smith and Иван Петров")
VALUES = ["john.smith@mail7.example.com", "+1 (017) 555-7713", "97.51.17.173", "4111 1111 1111 1111", "4111111111111111", "9807915762804490",
          "04dbebab91ab85687d33eeaaf9ac699e1188f962", "123-45-6789", "DE44 5001 0517 5407 3249 31", "Smith", "John", "Иван Петров"]
SCHEMA = "doc_id bigint, text string, kind string, value int"


def replaced(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    out = pii.replace(df, **options)
    assert out.columns == [*df.columns, "n_replaced"]
    return out.collect()


def test_detected():
    assert [(k, TEXT[b:e]) for b, e, k in pii.detect(TEXT)] == [
        ("person", "Mr. John Smith"), ("email", VALUES[0]), ("phone", VALUES[1]), ("ip", VALUES[2]), ("card", VALUES[3]), ("card", VALUES[4]),
        ("card", VALUES[5]), ("secret", VALUES[6]), ("ssn", VALUES[7]), ("iban", VALUES[8]), ("person", "Mrs Smith"), ("person", "Иван Петров")]


@pytest.mark.parametrize("text", ["Version 2.0 of 2024-01-02, 3.14159 and 1,000,000 at 12:30", "The end. of and\nund die der 7", "a@b", "1.2.3.4.5.6", ""])
def test_clean_texts_stay(text):
    assert pii.detect(text) == []


def test_surrogates_keep_kind_and_format(spark):
    row, = replaced(spark, [(1, TEXT)])
    assert not any(v in row.text for v in VALUES)
    assert row.n_replaced == 12
    again = pii.detect(row.text)
    assert [k for *_, k in again] == [k for *_, k in pii.detect(TEXT)]
    new = [row.text[b:e] for b, e, _ in again]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    old = [TEXT[b:e] for b, e, _ in pii.detect(TEXT)]
    for i in (1, 2, 4, 5, 6, 8):
        assert shape(new[i]) == shape(old[i])
    assert new[4].replace(" ", "") == new[5] and pii._luhn(new[5]) == 0
    first, last = new[0].split(" ")[1:]
    assert first in pii.GIVEN["latin", "m"] and first != "John" and new[10] == f"Mrs {last}" and last != "Smith"
    assert new[11].split(" ")[0] in pii.GIVEN["cyrillic", "m"]


def test_one_entity_one_surrogate_and_distinct(spark):
    numbers = [f"{i:016d}" for i in range(0, 4000, 7)]
    rows = [(i, f"pay {n} or {numbers[(i * 3) % len(numbers)]}") for i, n in enumerate(numbers)]
    new = {}
    for r in replaced(spark, rows):
        old = re.findall(r"\d{16}", dict(rows)[r.doc_id])
        for a, b in zip(old, re.findall(r"\d{16}", r.text), strict=True):
            assert new.setdefault(a, b) == b
    assert len(set(new.values())) == len(new) and not set(new.values()) & set(new)


def test_collisions_are_resolved(spark, monkeypatch):
    """With two-digit phone endings only, first attempts collide and hit other entities."""
    entities = spark.createDataFrame([("family", f"Name{chr(97 + i)}{chr(97 + j)}") for i in range(26) for j in range(20)], "kind string, value string")
    monkeypatch.setattr(pii, "SYLLABLES", {"latin": ("ba", "na", "mo"), "cyrillic": ("да",)})
    small = spark.createDataFrame([("family", f"N{chr(97 + i)}") for i in range(20)], "kind string, value string")
    rows = pii.attempts(small).collect()
    assert len(rows) == 20 and len({r.made for r in rows}) == 20
    assert len(pii.attempts(entities.limit(40).unionByName(spark.createDataFrame([("family", r.made) for r in rows[:3]], "kind string, value string"))).collect()) >= 40


def test_further_attempts_reach_the_documents(spark, monkeypatch):
    """An entity whose first surrogate is another entity of the corpus gets another."""
    one = "1234567890123456"
    two = pii.surrogate("card", one)
    out = {r.doc_id: r.text for r in replaced(spark, [(1, f"a {one} b"), (2, f"c {two} d"), (3, f"{one} {two}")])}
    new = re.findall(r"\d{16}", out[3])
    assert len({one, two, *new}) == 4
    assert out[1] == f"a {new[0]} b" and out[2] == f"c {new[1]} d"


def test_defined_cases(spark):
    long = "word " * 100_000 + "a@example.com"
    rows = [(1, None), (2, ""), (None, "x 97.51.17.173 y"), (3, TEXT), (3, TEXT), (3, "other 97.51.17.173"), (4, long)]
    out = replaced(spark, rows)
    assert len(out) == len(rows)
    texts = {(r.doc_id, r.n_replaced): r.text for r in out}
    assert texts[1, 0] is None and texts[2, 0] == "" and texts[None, 1][2:-2] in texts[3, 1] and len(texts[4, 1]) == len(long)
    assert replaced(spark, []) == []


SPELLINGS = {
    "phone": [["+49 30 1234567", "+49301234567", "+49-30-1234567"], ["+1 (017) 555-7713", "+1 017 555 7713"], ["+420 601 123 456", "+420601123456"]],
    "iban": [["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"]],
    "card": [["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]],
    "ipv6": [["2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:DB8::1"], ["fe80::a1:22", "FE80::A1:22"], ["::1", "0:0:0:0:0:0:0:1"]],
    "email": [["john.smith@mail7.example.com", "John.Smith@Mail7.example.com"]],
}


@pytest.mark.parametrize("kind", sorted(SPELLINGS))
def test_all_spellings_have_one_surrogate(kind):
    for written in SPELLINGS[kind]:
        new = [pii.surrogate(kind, w) for w in written]
        assert [pii.detect(w)[0][2] for w in written] == [kind] * len(written) == [pii.detect(n)[0][2] for n in new]
        assert len({pii.normal(kind, n) for n in new}) == 1 and not {pii.normal(kind, n) for n in new} & {pii.normal(kind, w) for w in written}
        for old, made in zip(written, new):
            if kind in ("phone", "iban", "card"):
                assert re.sub(r"[0-9A-Z]", "0", made) == re.sub(r"[0-9A-Z]", "0", old)


def test_country_codes_stay_and_check_digits_fit():
    for number, code in (("+49 30 1234567", "+49 "), ("+1 212 555 0100", "+1 "), ("+420 601 123 456", "+420 "), ("+74951234567", "+7")):
        assert pii.surrogate("phone", number).startswith(code)
    for number in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE44 5001 0517 5407 3249 31"):
        made = pii.surrogate("iban", number).replace(" ", "")
        assert made[:2] == number[:2] and int("".join(str(int(c, 36)) for c in made[4:] + made[:4])) % 97 == 1


def test_capitals_share_the_name(spark):
    row, = replaced(spark, [(1, "Mr Smith met JOHN SMITH and John Smith; std::vector, 12:30:45 and a::b stay")])
    family = row.text.split(" ")[1]
    given = row.text.split(" ")[6]
    assert row.text == f"Mr {family} met {given.upper()} {family.upper()} and {given} {family}; std::vector, 12:30:45 and a::b stay".replace(f"{family};", f"{family};")


def test_against_replacing_one_after_the_other(spark):
    """A whole small table against a plain loop over its entities, in which attempts are settled one entity after the other."""
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    entities = sorted({part for _, t in rows for b, e, k in pii.detect(t or "") for part in pii.parts_of(k, t[b:e])})
    tries, open_, taken = {}, {x: 0 for x in entities}, set()
    while open_:
        given = {x: (x[0], pii.normal(x[0], pii.surrogate(*x, n))) for x, n in open_.items()}
        settled = {}
        for x in sorted(open_):
            if given[x] not in entities and given[x] not in taken and given[x] not in settled:
                settled[given[x]] = x
        tries |= {x: open_[x] for x in settled.values()}
        taken |= settled.keys()
        open_ = {x: n + 1 for x, n in open_.items() if x not in settled.values()}
    wanted = {}
    for doc_id, text in rows:
        out, at = [], 0
        for b, e, k in pii.detect(text or ""):
            value = text[b:e]
            new = pii.person(value, tries) if k == "person" else pii.surrogate(k, value, tries[k, pii.normal(k, value)])
            out += [text[at:b], new]
            at = e
        wanted[doc_id] = "".join([*out, (text or "")[at:]])
    assert {r.doc_id: r.text for r in replaced(spark, rows)} == wanted
