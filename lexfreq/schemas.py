"""Table and frame schemas. `word_level` is the level of a word, `exam_level` that of a paper."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType, "INT": T.IntegerType, "BIGINT": T.LongType, "DOUBLE": T.DoubleType,
          "BOOLEAN": T.BooleanType, "TIMESTAMP": T.TimestampType}


def _struct(spec: str) -> T.StructType:
    """'name TYPE, ...' -> StructType, without needing a session as DDL parsing would."""
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in fields])


WORDLIST = _struct(
    "word STRING, pinyin STRING, word_level INT, definition STRING, definition_th STRING, created_at TIMESTAMP")
EXAM_SOURCES = _struct(
    "exam_id STRING, source_type STRING, year INT, exam_level INT, filename STRING, processed_at TIMESTAMP")
WORD_FREQUENCIES = _struct(
    "word STRING, word_level INT, source_type STRING, exam_id STRING, frequency BIGINT, "
    "in_official_wordlist BOOLEAN, created_at TIMESTAMP")
FREQUENCY_AGGREGATES = _struct(
    "word STRING, word_level INT, source_type STRING, total_frequency BIGINT, exam_count BIGINT, "
    "in_official_wordlist BOOLEAN, updated_at TIMESTAMP")
EXAM_SENTENCES = _struct(
    "exam_id STRING, source_type STRING, sentence STRING, created_at TIMESTAMP")

TABLES = {
    "wordlist": WORDLIST,
    "exam_sources": EXAM_SOURCES,
    "word_frequencies": WORD_FREQUENCIES,
    "frequency_aggregates": FREQUENCY_AGGREGATES,
    "exam_sentences": EXAM_SENTENCES,
}

WORD_COUNTS = _struct(
    "word STRING, level INT, exam_id STRING, exam_level INT, source_type STRING, count BIGINT, "
    "match_pattern STRING, effective_level INT, match_type STRING")
DOCUMENTS = _struct("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")

# The supplied tables. A given schema saves the job that would read it from a file.
SUPPLIED = {
    "documents": DOCUMENTS,
    "benchmark": _struct("item_id BIGINT, text STRING"),
    "labels": _struct("doc_id BIGINT, quality INT, toxic INT"),
    "conversations": _struct("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
    "pages": _struct("page_id BIGINT, url STRING, html STRING"),
}
