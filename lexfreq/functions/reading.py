"""Accent-, blank- and case-insensitive form of a pronunciation string."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every precomposed letter whose decomposition is one base letter plus combining marks."""
    accented, plain = [], []
    for code in range(0x00C0, 0x2000):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not "\u0300" <= c <= "\u036f")
        if base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


def without_accents(text: Column) -> Column:
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(text, accented, plain), r"[\u0300-\u036f]+", "")


def plain_reading(text: Column) -> Column:
    """'kě yǐ' -> 'keyi'."""
    return F.regexp_replace(F.lower(without_accents(text)), r"(?U)\s+", "")


def matches(word: Column, reading_plain: Column, query: str) -> Column:
    """The word holds the query, or its plain reading holds the plain query. Blank matches all."""
    asked = query.strip()
    if not asked:
        return F.lit(True)
    plain = plain_reading(F.lit(asked))
    by_reading = (F.length(plain) > 0) & F.contains(F.coalesce(reading_plain, F.lit("")), plain)
    return F.contains(word, F.lit(asked)) | by_reading
