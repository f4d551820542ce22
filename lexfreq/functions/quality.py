"""Extraction-quality and completeness columns, wordlist value checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lexfreq import fixed_values as V


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def ocr_reason(text: Column, pages: Column, artefact: str = V.ARTEFACT,
               per_page: int = V.MIN_CHARS_PER_PAGE, max_artefacts: int = V.MAX_ARTEFACTS) -> Column:
    """Why the text layer should be replaced by OCR; null when it is good."""
    return (F.when(is_blank(text), "empty")
            .when(F.length(text) / F.greatest(pages, F.lit(1)) < per_page, "sparse")
            .when(F.regexp_count(text, F.lit(artefact)) > max_artefacts, "cid"))


def ocr_note(reason: Column, ocr_result: Column | str = "ocr_ok") -> Column:
    """The note a file carries once the fallback for `reason` has run."""
    result = F.lit(ocr_result) if isinstance(ocr_result, str) else ocr_result
    return (F.when(reason.isNull(), F.lit("ok"))
            .when(reason == "empty", result)
            .otherwise(F.concat(reason, F.lit("_then_"), result)))


def method_label(notes: Column) -> Column:
    return (F.when(notes == "ok", V.METHOD_TEXT_LAYER)
            .when(notes == "ocr_ok", V.METHOD_SCANNED)
            .when(F.contains(notes, F.lit("sparse")), V.METHOD_SPARSE)
            .when(F.contains(notes, F.lit("cid")), V.METHOD_ARTEFACT)
            .otherwise("other"))


def is_done(notes: Column) -> Column:
    """A finished file: its note says ok and does not say empty."""
    return F.coalesce(F.contains(notes, F.lit("ok")) & ~F.contains(notes, F.lit("empty")), F.lit(False))


def length_bin(length: Column, bins=V.LENGTH_BINS) -> Column:
    """Right-closed bins, null outside."""
    low, high, label = bins[0]
    chain = F.when((length > low) & (length <= high), label)
    for low, high, label in bins[1:]:
        chain = chain.when((length > low) & (length <= high), label)
    return chain


def _issues(*parts: Column) -> Column:
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "OK").otherwise(joined)


def full_exam_checks(text: Column, exam_level: Column, section: str = V.SECTION_HEADING,
                     question: str = V.QUESTION_NUMBER, expected_sections: int = V.EXPECTED_SECTIONS,
                     expected_questions: dict[int, int] | None = None) -> dict[str, Column]:
    """n_sections, max_q, q_coverage and issues of a full exam paper."""
    table = V.EXPECTED_QUESTIONS if expected_questions is None else expected_questions
    expected = F.lit(0)
    for level, total in table.items():
        expected = F.when(exam_level == level, F.lit(total)).otherwise(expected)
    sections = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(section), 0)))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(question), 1), lambda n: n.cast("int"))
    in_range = F.filter(numbers, lambda n: n.between(1, V.LAST_QUESTION))
    last = F.coalesce(F.array_max(in_range), F.lit(0))
    coverage = F.when(expected > 0, F.bround(last / F.nullif(expected, F.lit(0)) * 100, 1)).otherwise(0.0)
    issues = _issues(
        F.when(sections < expected_sections,
               F.concat(F.lit("sections="), sections.cast("string"), F.lit(f"/{expected_sections}"))),
        F.when(last < expected * V.QUESTION_SHARE,
               F.concat(F.lit("max_q="), last.cast("string"), F.lit("/"), expected.cast("string"))))
    return {"n_sections": sections, "max_q": last, "q_coverage": coverage, "issues": issues}


def instruction_checks(text: Column, notice: str = V.NOTICE_HEADER, skills=V.SKILL_WORDS,
                       item: str = V.NOTICE_ITEM, expected_items: int = V.EXPECTED_ITEMS,
                       notice_name: str = "注意") -> dict[str, Column]:
    """Header, skill words and list items of an instruction sheet."""
    has_notice = text.rlike(notice)
    found = {column: text.rlike(pattern) for column, _, pattern in skills}
    items = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(item), 0)))
    missing = F.concat_ws(",", *[F.when(~found[column], F.lit(word)) for column, word, _ in skills])
    issues = _issues(
        F.when(~has_notice, F.lit(f"no {notice_name} header")),
        F.when(missing != "", F.concat(F.lit("missing: "), missing)),
        F.when(items < expected_items,
               F.concat(F.lit("notice_items="), items.cast("string"), F.lit(f"/{expected_items}"))))
    return {"has_notice": has_notice, **found, "notice_items": items, "issues": issues}


def checked_level(raw: Column) -> Column:
    """'3', '3.0' -> 3; blank, nan, unreadable or outside 1..9 -> null."""
    number = F.expr("CAST(NULL AS DOUBLE)") if raw is None else raw.try_cast("double")
    whole = F.when(~F.isnan(number), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
    return F.when(whole.between(*V.LEVELS), whole.cast("int"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only ASCII blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def all_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags) if flags else F.lit(True)
