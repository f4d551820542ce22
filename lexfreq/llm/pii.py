"""Operator 10, personal data replaced by consistent surrogates.

Detected: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, payment-card and account numbers, social-security numbers, IBANs,
secrets (long hexadecimal or token-like values) and person names after a title or beginning with a known given name.

A surrogate is made from the normal form of the entity with a key and nothing else, so an entity has the same one everywhere, in whatever document
and spelling, and is then written as the entity was: a telephone number or IBAN with or without blanks, an address in capitals, an IPv6
address in short or in full. It keeps the kind and format: digits stand for digits, letters for letters of their script, separators, country codes
and zero groups of addresses stay; card numbers that pass the Luhn check still do; IBANs get the check digits they need; IP octets stay in
range; given names are replaced by given names of the same gender and script, family names part by part, so "Mr Smith", "JOHN SMITH" and
"John Smith" still share a name. Persons without a title are found by given names on the list only. Numbers are replaced by a keyed Feistel permutation of the numbers of their
format, which cannot give two numbers the same surrogate.

Collision checks: the table of all distinct entities is compared with itself in Spark. An entity whose surrogate is also another entity's
surrogate, or is an entity of the corpus, is given the next attempt, until there are no such cases. What needed
further attempts is joined to the documents that mention it; everything else is derived in place, so no table of entities
is sent to all tasks.

Defined cases: null texts stay null, empty ones empty. Rows alike in doc_id and text are treated alike. Every row and column is kept.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, fresh, written

KEY = b"surrogates"

# Given names by script and gender, and syllables for family names.
GIVEN = {
    ("latin", "f"): ("Anna", "Alice", "Barbara", "Carla", "Claire", "Diana", "Elena", "Emma", "Eva", "Helen", "Ingrid", "Irene", "Julia", "Karin",
                     "Laura", "Lucia", "Maria", "Mary", "Monica", "Nina", "Olga", "Paula", "Rosa", "Sarah", "Sofia", "Teresa", "Ursula", "Vera"),
    ("latin", "m"): ("Adam", "Albert", "Andreas", "Anton", "Bruno", "Carlos", "Daniel", "David", "Erik", "Felix", "Frank", "George", "Hans", "Henry",
                     "Hugo", "James", "Jean", "John", "Jorge", "Karl", "Luis", "Martin", "Michael", "Oscar", "Paul", "Peter", "Robert", "Thomas"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f",
          "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f"}
SYLLABLES = {
    "latin": ("ba", "ber", "cor", "dal", "den", "fel", "gar", "hol", "kin", "lan", "lor", "mar", "mel", "nor", "pel", "ras", "ros", "sen", "tor", "val",
              "ven", "wel", "wil", "zan"),
    "cyrillic": ("ба", "вол", "гор", "дал", "зим", "кар", "лес", "мар", "нов", "пет", "рос", "сав", "тар", "фад"),
}

# Country calling codes of one and two digits; all others have three.
CALLING_CODES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                 "81 82 84 86 90 91 92 93 94 95 98")

_CODES = frozenset(CALLING_CODES.split())
_GENDER = {name: kind for kind, names in GIVEN.items() for name in names}
_NAME = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я'’-]+"
_CAPITALS = r"[A-ZÀ-ÖØ-ÞА-Я][A-ZÀ-ÖØ-ÞА-Я'’-]+"
_PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::"
            r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "secret": r"(?<![\w])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|gh[a-z]|xox[a-z])[-_][A-Za-z0-9_-]{16,})(?![\w])",
    "person": rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(_GENDER)}) {_NAME}|(?:{'|'.join(n.upper() for n in _GENDER)}) {_CAPITALS})(?!\w)",
}
# What has no digit, @ or name cue in it cannot hold an entity.
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()))
_NUMERIC = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items() if kind != "person"))
_CUE = re.compile(rf"(?:{'|'.join(sorted({*TITLES, *_GENDER, *(n.upper() for n in _GENDER)}, key=len, reverse=True))})(?!\w)")
_SOME = re.compile(r"[0-9@]")
_LONG = re.compile(r"[0-9A-Fa-f]{32}|(?:sk|pk|gh[a-z]|xox[a-z])[-_]")


def _is_address(value: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def detect(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of every entity, in order and apart from each other. Entities never cross a line."""
    found = []
    at = 0
    for line in text.split("\n"):
        pattern = _ANY if _CUE.search(line) else _NUMERIC if _SOME.search(line) or _LONG.search(line) else None
        if pattern:
            found += [(at + m.start(), at + m.end(), m.lastgroup) for m in pattern.finditer(line)
                      if m.lastgroup != "ipv6" or _is_address(m[0])]
        at += len(line) + 1
    return found


def normal(kind: str, value: str) -> str:
    """How an entity is known: formats of numbers do not matter, nor the case of addresses."""
    if kind in ("phone", "card", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", value).upper()
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "family":
        return value.capitalize() if value.isupper() else value
    return value.lower() if kind == "email" or kind == "secret" and re.fullmatch("[0-9A-Fa-f]+", value) else value


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    seed = hmac.new(key, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest()
    n = 0
    while True:
        yield from hashlib.sha256(seed + n.to_bytes(4, "big")).digest()
        n += 1


def _number(key: bytes, tweak: str, digits: str) -> str:
    """A keyed permutation of the numbers with as many digits: an unbalanced Feistel network of ten rounds on two halves."""
    if len(digits) < 2:
        return "".join(str((int(d) + next(_stream(key, tweak)) % 10) % 10) for d in digits)
    cut = len(digits) // 2
    a, b = digits[:cut], digits[cut:]
    for r in range(10):
        pad = int.from_bytes(hmac.new(key, f"{tweak}\0{len(digits)}\0{r}\0{b}".encode(), hashlib.sha256).digest()[:16], "big")
        a, b = b, str((int(a) + pad) % 10**len(a)).zfill(len(a))
    return a + b


def _in_format(original: str, digits: str) -> str:
    """The digits in the places of the digits of the original."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in original)


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def _letters(key: bytes, tweak: str, value: str) -> str:
    """Letters for letters and digits for digits, of the same case; other characters stay."""
    bytes_ = _stream(key, tweak, value.lower())
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(next(bytes_) % 10))
        elif c.isalpha():
            script = "абвгдезиклмнопрст" if "а" <= c.lower() <= "я" else "abcdefghijklmnopqrstuvwxyz"
            new = script[next(bytes_) % len(script)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _family(key: bytes, tweak: str, name: str) -> str:
    script = "cyrillic" if re.match("[А-Яа-я]", name) else "latin"
    bytes_ = _stream(key, "family", tweak, name)
    made = "".join(SYLLABLES[script][next(bytes_) % len(SYLLABLES[script])] for _ in range(3 + next(bytes_) % 2))
    return made.capitalize()


@lru_cache(maxsize=64)
def _given_order(key: bytes, kind: tuple[str, str]) -> dict[str, str]:
    """Given names of one script and gender, each with the one after it in a keyed order: a permutation that moves all."""
    names = sorted(GIVEN[kind], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
    return dict(zip(names, [*names[1:], names[0]]))


def parts_of(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities whose surrogates must be distinct: the value, or the family names of a person."""
    if kind != "person":
        return [(kind, normal(kind, value))]
    return [("family", normal("family", word)) for word in value.split(" ") if word.rstrip(".") not in TITLES and word.capitalize() not in _GENDER]


def person(value: str, attempts_of: dict[tuple[str, str], int], key: bytes = KEY) -> str:
    """Titles stay, given names go by gender and script, family names one by one."""
    out = []
    for word in value.split(" "):
        if word.capitalize() in _GENDER:
            given = _given_order(key, _GENDER[word.capitalize()])[word.capitalize()]
            out.append(given.upper() if word.isupper() else given)
        elif word.rstrip(".") in TITLES:
            out.append(word)
        else:
            out.append(surrogate("family", word, attempts_of.get(("family", normal("family", word)), 0), key))
    return " ".join(out)


def _network(key: bytes, tweak: str, value: str) -> str:
    """A keyed permutation of the IPv4 addresses."""
    a, b, c, d = map(int, value.split("."))
    left, right = a << 8 | b, c << 8 | d
    for r in range(10):
        pad = int.from_bytes(hmac.new(key, f"ip\0{tweak}\0{r}\0{right}".encode(), hashlib.sha256).digest()[:2], "big")
        left, right = right, left ^ pad
    return f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"


def _check_digits(country: str, account: str) -> str:
    """What makes an IBAN leave 1 when divided by 97; letters count as 10 to 35."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def _once(key: bytes, kind: str, value: str, tweak: str) -> str:
    """The surrogate of a normal form, in normal form."""
    if kind == "email":
        user, _, domain = value.partition("@")
        name, _, rest = domain.partition(".")
        return f"{_letters(key, tweak + user, user)}@{_letters(key, 'domain', name)}.{rest}"
    if kind == "ip":
        return _network(key, tweak, value)
    if kind == "family":
        return _family(key, tweak, value)
    if kind == "ipv6":
        # Groups of zeros stay, so that what is written in short can be written in short.
        bytes_ = _stream(key, tweak, value)
        return ":".join(g if g == "0000" else f"{(next(bytes_) << 8 | next(bytes_)) % 0xFFFF + 1:04x}" for g in value.split(":"))
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", value):
            bytes_ = _stream(key, tweak, value)
            return "".join("0123456789abcdef"[next(bytes_) % 16] for _ in value)
        return _letters(key, tweak, value)
    if kind == "iban":
        account = _letters(key, tweak, value[4:])
        return value[:2] + _check_digits(value[:2], account) + account
    digits = re.sub(r"\D", "", value)
    if kind == "card" and _luhn(digits) == 0:
        body = _number(key, "card" + tweak, digits[:-1])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "phone" and value.startswith("+"):
        keep = next((n for n in (1, 2) if digits[:n] in _CODES), 3)
        return "+" + digits[:keep] + _number(key, "phone" + tweak, digits[keep:])
    return _number(key, kind + tweak, digits)


def _as_written(kind: str, original: str, made: str) -> str:
    """A surrogate in normal form, laid out as the original is written."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(made.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in original)
    if kind == "ipv6":
        groups = made.split(":")
        head, short, tail = original.partition("::")
        sides = [side.split(":") if side else [] for side in (head, tail)]
        new = [groups[:len(sides[0])], groups[len(groups) - len(sides[1]):] if sides[1] else []]
        out = [":".join(n.lstrip("0").zfill(len(o)) if n != "0000" else o for n, o in zip(*pair)) for pair in zip(new, sides)]
        return (out[0] + short + out[1]).upper() if original.upper() == original and original.lower() != original else out[0] + short + out[1]
    if kind == "family" or kind == "secret":
        return made.upper() if original.isupper() else made
    if kind == "email":
        return "".join(m.upper() if o.isupper() else m for o, m in zip(original, made))
    return made


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of an entity, as the entity is written; all spellings of an entity have one normal form and so has their surrogate."""
    own = normal(kind, value)
    made = _once(key, kind, own, str(attempt) if attempt else "")
    step = 0
    while made == own:
        step += 1
        made = _once(key, kind, own, f"{attempt}+{step}")
    return _as_written(kind, value, made)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind and value (in normal form) of every entity of every document, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kinds, values = [], [], []
            for i, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                for kind, value in sorted({part for b, e, kind in detect(text) for part in parts_of(kind, text[b:e])}):
                    row.append(i)
                    kinds.append(kind)
                    values.append(value)
            picked = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(picked), batch["text_key"].take(picked), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                ["doc_id", "text_key", "kind", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return arrow_map(wanted, run, f"doc_id {kind}, text_key bigint, kind string, value string")


def _given(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt and the surrogate, in normal form, that the attempt gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["kind"].to_pylist(), batch["value"].to_pylist(), batch["attempt"].to_pylist())
            made = [normal(k, surrogate(k, v, n, key)) for k, v, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    return arrow_map(entities.select("kind", "value", "attempt"), run, "kind string, value string, attempt int, made string")


def attempts(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, attempt and made of every entity: distinct surrogates, none of them an entity."""
    entities = written(entities.select("kind", "value").distinct(), "entities")
    settled = None
    open_ = entities.withColumn("attempt", F.lit(0))
    while True:
        given = _given(open_, key)
        names = entities.select("kind", F.col("value").alias("made"))
        # Of those with the same surrogate one keeps it, unless the surrogate is taken already.
        first = given.groupBy("kind", "made").agg(F.min("value").alias("value"))
        free = first.join(names, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "made"], "left_anti")
        done = given.join(free, ["kind", "made", "value"], "left_semi").select("kind", "value", "attempt", "made")
        settled = written(done if settled is None else settled.unionByName(done), "surrogates")
        open_ = written(given.join(settled, ["kind", "value"], "left_anti").select(
            "kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt")), "open_entities")
        if open_.isEmpty():
            return settled


def replace(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """All columns of the documents, with surrogates in the text, and n_replaced; a column of that name is replaced."""
    docs = docs.drop("n_replaced")
    names = docs.columns
    id_, text_key, tried = fresh(names, "_id", "_key", "_later")
    own = written(mentions(docs), "mentions")
    again = attempts(own, key).filter("attempt > 0").select("kind", "value", "attempt")
    # Usually empty and always small files, so Spark knows whether the texts must move for this join.
    later = written(own.join(again, ["kind", "value"]).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias(tried))
        .select(F.col("doc_id").alias(id_), F.col("text_key").alias(text_key), tried), "further_attempts")
    joined = docs.join(later, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(text_key)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(maxsize=1 << 14)(lambda kind, value, attempt: surrogate(kind, value, attempt, key))
        for batch in batches:
            texts, counts = [], []
            for text, later_ in zip(batch["text"], batch[tried]):
                text = text.as_py()
                found = detect(text) if text else []
                if found:
                    tries = {(x["kind"], x["value"]): x["attempt"] for x in later_.as_py() or ()}
                    parts, at = [], 0
                    for begin, end, kind in found:
                        value = text[begin:end]
                        parts += [text[at:begin], person(value, tries, key) if kind == "person"
                                  else made(kind, value, tries.get((kind, normal(kind, value)), 0))]
                        at = end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                counts.append(len(found))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_replaced"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(joined.select(*names, tried), run, f"{fields}, n_replaced bigint")
