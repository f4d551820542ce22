"""Columns read from file names: exam, level, year, kind of file, copy score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lexfreq import fixed_values as V


def _group(name: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, index), F.lit(""))


def exam_id(name: Column, pattern: str = V.EXAM_NAME) -> Column:
    """Upper-cased exam id at the start of the name, null when the name has none."""
    return F.upper(_group(name, pattern, 1))


def exam_level(name: Column, pattern: str = V.EXAM_NAME) -> Column:
    return _group(name, pattern, 2).cast("int")


def year(name: Column, pattern: str = V.YEAR_IN_NAME) -> Column:
    return _group(name, pattern, 1).cast("int")


def level_tag(name: Column, pattern: str = V.LEVEL_IN_NAME) -> Column:
    return _group(name, pattern, 1).cast("int")


def prefixed_exam_id(source_type: Column, name: Column) -> Column:
    """source_type + '_' + file stem."""
    return F.concat_ws("_", source_type, F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", ""))


def copy_score(name: Column, marks=V.COPY_MARKS) -> Column:
    """The higher, the more the name looks like a spare copy."""
    lowered = F.lower(name)
    return reduce(lambda a, b: a + b,
                  [F.when(F.contains(lowered, F.lit(mark)), points).otherwise(0) for mark, points in marks])


def source_type(name: Column) -> Column:
    return F.when(F.endswith(F.lower(name), F.lit(".pdf")), "reading").otherwise("listening")


def file_type(name: Column, marks=V.INSTRUCTION_MARKS) -> Column:
    lowered = F.lower(name)
    is_sheet = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in marks])
    return F.when(is_sheet, "instruction_sheet").otherwise("full_exam")
