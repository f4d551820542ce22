"""Operator 4, line deduplication by overlapping three-line windows.

A text is cut at line feeds. Every three consecutive lines make a window; lines are compared without
the white space around them, and a window of nothing but blank lines does not count. The first
occurrence of a window, by doc_id and then position, stays; the lines of all later occurrences, in the same
or another document, go. Windows overlap, so the positions they cover are merged: a passage of many lines that
repeats goes as one piece.

A window is known by two 64-bit hashes of its lines. One aggregation, combined before its shuffle, finds the
first occurrence of every repeated window; the windows are then joined with these, and a window that
a third of all documents share is only a large key on one side of that join, which Spark splits.

Defined cases: a null text stays null; a text of fewer than three lines has no windows and stays as
it is. Documents are told apart by doc_id and text: rows alike in both are treated alike, none being a
later occurrence of the other. A null doc_id comes before all others. All columns and rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import fresh

WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key of the text, position and hashes of each window."""
    trimmed = F.transform(_lines(), lambda line: F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")))
    wide = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), trimmed.alias("lines"))
    wide = wide.filter(F.size("lines") >= window)

    def at(i: Column) -> Column:
        own = F.slice("lines", i, window)
        joined = F.array_join(own, "\n")
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(joined).alias("h1"), F.xxhash64(joined, F.lit(1)).alias("h2"),
                        (F.length(joined) >= window).alias("filled"))

    positions = F.sequence(F.lit(1), F.size("lines") - window + 1)
    return (wide.select("doc_id", "text_key", F.inline(F.transform(positions, at)))
            .filter("filled").drop("filled"))


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key and position (from 1) of every window that occurs earlier too."""
    windows = _windows(docs, window)
    place = F.struct("doc_id", "pos", "text_key")
    # Rows alike in doc_id and text are one document.
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter("first <> last").select("h1", "h2", "first")
    return windows.join(firsts, ["h1", "h2"]).filter(place != F.col("first")).select("doc_id", "text_key", "pos")


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of the documents, the text without repeated lines, n_lines and n_removed; columns of these two names are replaced."""
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    id_, key, starts, lines, went = fresh(columns, "_id", "_key", "_starts", "_lines", "_gone")
    gone = later_windows(docs, window).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias(starts))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), starts)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + window - 1))))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    joined = joined.withColumn(lines, _lines()).withColumn(went, F.coalesce(covered, F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), went)
    text = F.when(F.size(went) == 0, F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(lines, i)), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns],
                         F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.size(went).alias("n_removed"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT doc_id, text, i AS pos, [trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') FOR x IN l[i:i + 2]] AS own
  FROM split, unnest(range(1, len(l) - 1)) AS t(i)),
filled AS (SELECT doc_id, text, pos, array_to_string(own, chr(10)) AS w FROM placed
           WHERE len(array_to_string(own, '')) > 0),
firsts AS (SELECT w, min(row(doc_id, pos)) AS f FROM filled GROUP BY w HAVING count(DISTINCT row(doc_id, pos)) > 1),
covered AS (
  SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS p
  FROM filled JOIN firsts USING (w) WHERE row(doc_id, pos) <> f),
gone AS (SELECT doc_id, text, list(p) AS g FROM covered GROUP BY doc_id, text)
SELECT d.doc_id,
  CASE WHEN g IS NULL THEN d.text ELSE
    array_to_string([x[2] FOR x IN list_zip(range(1, len(string_split(d.text, chr(10))) + 1), string_split(d.text, chr(10)))
                     IF NOT list_contains(g, x[1])], chr(10)) END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INTEGER AS n_lines,
  coalesce(len(g), 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM d.doc_id AND gone.text = d.text
"""
