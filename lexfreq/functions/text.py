"""Text columns: repeats, clauses, markers, tokens, sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lexfreq import fixed_values as V

LETTERS = r"\p{L}"


def clauses(text: Column, ends: str = V.CLAUSE_ENDS) -> Column:
    """Split behind clause punctuation, without blank pieces."""
    return F.filter(F.split(text, f"(?<=[{ends}])"), lambda c: c.rlike(r"(?U)\S"))


def marker_count(text: Column, markers=V.TRADITIONAL_MARKERS) -> Column:
    """Total number of occurrences of the marker strings."""
    return reduce(lambda a, b: a + b, [
        ((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("int")
        for m in markers])


def tokens(text: Column, pattern: str = rf"({LETTERS}+)") -> Column:
    """Lower-cased tokens of a script that separates its words."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 1)


def keep_script(words: Column, script: str = V.HAN, mode: str = "all") -> Column:
    """Keep tokens that are wholly (`all`) or partly (`any`) in the script."""
    if mode not in ("all", "any"):
        raise ValueError("mode is 'all' or 'any'")
    pattern = rf"\A[{script}]+\z" if mode == "all" else f"[{script}]"
    return F.filter(words, lambda w: w.rlike(pattern))


def sentence_parts(text: Column, ends: str = V.SENTENCE_ENDS) -> Column:
    """Split behind sentence ends and at line breaks, without empty pieces."""
    return F.filter(F.split(text, rf"(?<=[{ends}])|[\n\r]+"), lambda s: s != "")


def strip_lead(text: Column, script: str = V.HAN, glued: bool = True) -> Column:
    """Remove question numbers, option letters, the example mark and punctuation from the front.

    No alternative matches the empty string, so one repeated group strips as far as repeated
    passes would. Trailing white space goes in the same pass. `glued` is for scripts without
    blanks, where a number or an option letter may touch the sentence.
    """
    after_letter = rf"[\s,，．.]|[{script}]" if glued else r"[\s,，．.]"
    alternatives = [
        r"\s+", V.EXAMPLE_LEAD,
        rf"[{V.DIGITS}]{{1,3}}\s*[{V.NUMBER_SEPARATORS}]",
        rf"[{V.HAN_NUMBERS}]{{1,3}}\s*[{V.NUMBER_SEPARATORS}]",
        *([rf"[{V.DIGITS}]{{1,3}}(?=[{script}])"] if glued else []),
        rf"[{V.OPTION_LETTERS}](?={after_letter})",
        rf"[{V.LEAD_CLUSTER}]+",
    ]
    return F.regexp_replace(text, rf"(?U)\A(?:{'|'.join(alternatives)})+|\s+\z", "")


def script_chars(text: Column, script: str = V.HAN) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{script}]+", ""))


def reads_as_sentence(text: Column, script: str = V.HAN) -> Column:
    """Enough script characters, not too long, no stray option letter or empty bracket."""
    edge = r"[\s，,。.]"
    noise = rf"(?U)(?:^|{edge})[{V.OPTION_LETTERS}](?:{edge}|$)|[（(]\s*[）)]"
    n = script_chars(text, script)
    return (F.length(text).between(V.MIN_SCRIPT_CHARS, V.MAX_SENTENCE) & (n >= V.MIN_SCRIPT_CHARS)
            & (n / F.length(text) >= V.MIN_SCRIPT_SHARE) & ~text.rlike(noise))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def preview(text: Column, size: int = 400) -> Column:
    return F.substr(text, F.lit(1), F.lit(size))


def middle_preview(text: Column, size: int = 400) -> Column:
    return F.substr(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(size))
