"""Inventory, file summaries, upserts, constraint checks, written tables and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfreq.functions import names, quality
from lexfreq.operators import checks, counts as C
from lexfreq.operators.keyed import first_per_key
from lexfreq.plans import analysis as A, corpus as K
from lexfreq.registry import inputs as I
from lexfreq.registry.base import query
from lexfreq.registry.inputs import sql
from lexfreq.schemas import DOCUMENTS
from lexfreq.session import scratch_path
from lexfreq.sources import files as FL, sinks, tables
from lexfreq.sources.versions import KeyedTable, Refused
from lexfreq.streaming import incremental

# --- names and inventory ------------------------------------------------------------------------

_NAMES = """
  named AS (SELECT doc_id, source_type AS lang, n_chars, filename, upper(regexp_extract(filename, '^([hH]([34])\\d{4}[A-Za-z]?)', 1)) AS exam_id,
      CAST(regexp_extract(filename, '^[hH]([34])\\d{4}', 1) AS INTEGER) AS exam_level,
      CAST(nullif(regexp_extract(filename, '(20\\d{2})', 1), '') AS INTEGER) AS year,
      CAST(nullif(regexp_extract(filename, '[hH]3(\\d)', 1), '') AS INTEGER) AS level_tag,
      source_type || '_' || regexp_replace(filename, '\\.[^.]*$', '') AS prefixed_id,
      CAST(CASE WHEN contains(lower(filename), '_copy') THEN 10 ELSE 0 END + CASE WHEN contains(lower(filename), '-audio') THEN 10 ELSE 0 END
        + CASE WHEN contains(lower(filename), '试卷') THEN 5 ELSE 0 END + CASE WHEN contains(lower(filename), '(1)') THEN 3 ELSE 0 END AS INTEGER) AS copy_score,
      CASE WHEN ends_with(lower(filename), '.pdf') THEN 'reading' ELSE 'listening' END AS source_type,
      CASE WHEN contains(lower(filename), 'exam-paper') OR contains(filename, '试卷') THEN 'instruction_sheet' ELSE 'full_exam' END AS file_type
    FROM files)"""


def _with_names(body: str) -> str:
    return sql("files", "") + "," + _NAMES + body


def _listed(spark, sf):
    return I.files(spark, sf).select(F.col("filename"), F.col("n_chars").alias("size"))


@query("file_names", _with_names("""
  SELECT filename, exam_id, exam_level, year, level_tag, prefixed_id, copy_score, source_type, file_type FROM named"""))
def _(spark, sf):
    name = F.col("filename")
    return I.files(spark, sf).select(
        "filename", names.exam_id(name).alias("exam_id"), names.exam_level(name).alias("exam_level"),
        names.year(name).alias("year"), names.level_tag(name, r"(?i)h3(\d)").alias("level_tag"),
        names.prefixed_exam_id(F.col("source_type"), name).alias("prefixed_id"),
        names.copy_score(name).alias("copy_score"), names.source_type(name).alias("source_type"),
        names.file_type(name).alias("file_type"))


@query("best_copies", _with_names("""
  SELECT filename, n_chars AS size, exam_id, exam_level, source_type FROM named
  QUALIFY row_number() OVER (PARTITION BY exam_id, source_type ORDER BY copy_score, filename) = 1"""))
def _(spark, sf):
    return FL.best_copies(FL.describe_files(_listed(spark, sf)))


@query("duplicate_files", _with_names("""
  SELECT exam_id, source_type, filename, kept, filename = kept AS is_kept FROM (
    SELECT *, first_value(filename) OVER (PARTITION BY exam_id, source_type ORDER BY copy_score, filename) AS kept,
           count(*) OVER (PARTITION BY exam_id, source_type) AS n FROM named) WHERE n > 1"""))
def _(spark, sf):
    return FL.duplicate_files(FL.describe_files(_listed(spark, sf)))


@query("only_in_one_source", """
  SELECT exam_id, min(source_type) AS source_type FROM (
    SELECT word AS exam_id, 'benchmark' AS source_type FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark)
    UNION ALL SELECT word, 'conversations' FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations))
  GROUP BY 1 HAVING min(source_type) = max(source_type)""")
def _(spark, sf):
    # Words stand for exams and the tables they occur in for source types: some are in one only, some in both.
    return FL.only_in_one_source(_word_rows(spark, sf, "benchmark", 6).unionByName(_word_rows(spark, sf, "conversations", 9))
                                 .select(F.col("word").alias("exam_id"), F.col("pinyin").alias("source_type")))


@query("first_file_per_source", sql("files", """
  SELECT exam_id, source_type, doc_id, n_chars FROM files
  QUALIFY row_number() OVER (PARTITION BY exam_id, source_type ORDER BY doc_id) = 1"""))
def _(spark, sf):
    files = I.files(spark, sf).select("exam_id", "source_type", "doc_id", "n_chars")
    return first_per_key(files, ["exam_id", "source_type"], [F.asc("doc_id")])


@query("files_per_source", sql("files", "SELECT exam_level, source_type, count(*) AS files FROM files GROUP BY 1, 2"))
def _(spark, sf):
    return A.files_per_source(I.files(spark, sf))


def _sized(spark, sf):
    return I.files(spark, sf).select("exam_level", "source_type", F.length("text").alias("text_length"),
                                     F.col("n_chars").alias("size_mb"))


@query("extraction_summary", sql("files", """
  SELECT exam_level, source_type, count(*) AS files, avg(length(text)) AS avg_chars,
         count(*) FILTER (length(text) = 0) AS empty_files FROM files GROUP BY 1, 2"""))
def _(spark, sf):
    return A.extraction_summary(_sized(spark, sf))


@query("length_groups", """
  SELECT CASE WHEN length(text) <= 600 THEN '<600' WHEN length(text) <= 4000 THEN '600-4k'
              WHEN length(text) <= 7000 THEN '4k-7k' ELSE '>7k' END AS length_group,
         count(*) AS files, avg(length(text)) AS avg_chars, avg(n_chars) AS avg_mb
  FROM documents WHERE length(text) BETWEEN 1 AND 20000 GROUP BY 1
  UNION ALL SELECT 'other', count(*), avg(length(text)), avg(n_chars) FROM documents
  WHERE coalesce(length(text) NOT BETWEEN 1 AND 20000, true) HAVING count(*) > 0""")
def _(spark, sf):
    return A.length_groups(_sized(spark, sf))


@query("combined_extractions", sql("files", """
  SELECT exam_level, exam_id, source_type, filename, CAST(length(text) AS INTEGER) AS text_length FROM files"""))
def _(spark, sf):
    rows = I.files(spark, sf).select("exam_level", "exam_id", "source_type", "filename",
                                     F.length("text").alias("text_length"))
    is_paper = names.source_type(F.col("filename")) == "reading"
    return A.combine_extractions(rows.filter(is_paper), rows.filter(~is_paper))


@query("pending_files", sql("files", """
  SELECT filename, doc_id FROM files WHERE filename NOT IN (
    SELECT filename FROM files JOIN labels USING (doc_id) WHERE quality = 1)"""))
def _(spark, sf):
    files = I.files(spark, sf).select("filename", "doc_id")
    progress = (files.join(I.table(spark, sf, "labels"), "doc_id")
                .withColumn("notes", F.when(F.col("quality") == 1, "sparse_then_ocr_ok").otherwise("ocr_empty")))
    return FL.pending_files(files, progress, quality.is_done(F.col("notes")))


# --- word list and dictionary input ---------------------------------------------------------------

_LEVELS = """
  raw AS (SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) ELSE value END AS level,
                 event_type FROM events),
  checked AS (SELECT CAST(event_id AS VARCHAR) AS word, CASE WHEN trunc(level) BETWEEN 1 AND 9 THEN CAST(trunc(level) AS INTEGER) END AS word_level,
                     CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS definition FROM raw)"""


def _raw_wordlist(spark, sf):
    events = I.table(spark, sf, "events")
    is_view = F.col("event_type") == "view"
    return tables.wordlist_rows(events.select(
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("　")).alias("word"),
        F.when(is_view, "").otherwise(F.col("value").cast("string")).alias("hsk_level"),
        F.regexp_extract("props", r'"k": (\d+)', 1).alias("level"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("definition")))


@query("wordlist_accepted", "WITH " + _LEVELS + " SELECT * FROM checked WHERE word_level IS NOT NULL")
def _(spark, sf):
    return tables.accepted(_raw_wordlist(spark, sf)).select("word", "word_level", "definition")


@query("wordlist_rejected", "WITH " + _LEVELS + " SELECT word FROM checked WHERE word_level IS NULL")
def _(spark, sf):
    return tables.rejected(_raw_wordlist(spark, sf)).select("word")


@query("wordlist_snapshot", """
  SELECT user_id AS id, arg_min(event_type, event_id) AS word,
         CAST(arg_min(regexp_extract(props, '"k": (\\d+)', 1), event_id) AS INTEGER) AS level FROM events GROUP BY 1""")
def _(spark, sf):
    records = I.table(spark, sf, "events").select(
        F.col("user_id").alias(" ID"), F.col("event_type").alias("Word"),
        F.get_json_object("props", "$.k").alias("Level"), F.col("value").alias("Unwanted"),
        F.col("event_id").alias("page"))
    return tables.wordlist_snapshot(records)


@query("dictionary_headwords", """
  SELECT DISTINCT string_split(line, ' ')[2] AS word
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE NOT starts_with(line, '#') AND regexp_matches(line, '[^\\s\\pZ]') AND len(string_split(line, ' ')) >= 2""")
def _(spark, sf):
    lines = I.files(spark, sf).select(F.explode(F.split("text", "\n")).alias("value"))
    return tables.headwords(tables.dictionary_entries(lines))


# --- upserts -----------------------------------------------------------------------------------------

def _upserted(old, new, keys, order, update_cols=None):
    """What a versioned table holds after a load of `old` and an upsert of `new`."""
    spark = old.sparkSession
    own = KeyedTable(spark, scratch_path(spark, "versioned"), old.schema, keys)
    own.replace(old)
    own.upsert(new, order, update_cols)
    return own.read()


def _word_rows(spark, sf, name, cap):
    words = K.spaced_tokens(I.table(spark, sf, name).select("text")).distinct()
    return words.select("word", F.lit(name).alias("pinyin"),
                        F.least(F.lit(cap), F.length("word")).alias("word_level"))


@query("wordlist_upsert", """
  WITH old AS (SELECT word, least(6, length(word)) AS l FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark)),
  new AS (SELECT word, least(9, length(word)) AS l FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations))
  SELECT word, 'conversations' AS pinyin, CAST(l AS INTEGER) AS word_level FROM new
  UNION ALL SELECT word, 'benchmark', CAST(l AS INTEGER) FROM old WHERE word NOT IN (SELECT word FROM new)""")
def _(spark, sf):
    return _upserted(_word_rows(spark, sf, "benchmark", 6), _word_rows(spark, sf, "conversations", 9), ["word"], [F.asc("word_level")])


def _halves(spark, sf):
    """All files in two deliveries: those of documents marked as good come later."""
    good = I.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    files = I.files(spark, sf)
    return files.join(good, "doc_id", "left_anti"), files.join(good, "doc_id", "left_semi")


_HALVES = """,
  f0 AS (SELECT * FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
  f1 AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""


@query("source_upsert", sql("files", "") + _HALVES + """,
  s0 AS (SELECT exam_id, source_type, max(year) AS year, max(exam_level) AS exam_level, min(filename) AS filename FROM f0 GROUP BY 1, 2),
  s1 AS (SELECT exam_id, source_type, max(year) AS year, max(exam_level) AS exam_level, min(filename) AS filename FROM f1 GROUP BY 1, 2)
  SELECT * FROM s1 UNION ALL SELECT * FROM s0 WHERE (exam_id, source_type) NOT IN (SELECT (exam_id, source_type) FROM s1)""")
def _(spark, sf):
    old, new = _halves(spark, sf)
    return _upserted(sinks.source_rows(old), sinks.source_rows(new), ["exam_id", "source_type"], [F.asc("filename")])


@query("frequency_upsert", sql("files wl", "") + _HALVES + """,
  c0 AS (SELECT word, source_type, exam_id, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM f0) GROUP BY ALL),
  c1 AS (SELECT word, source_type, exam_id, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM f1) GROUP BY ALL)
  SELECT word, source_type, exam_id, coalesce(c1.n, c0.n) AS frequency,
         CASE WHEN c0.n IS NOT NULL THEN wl.word_level ELSE 9 END AS word_level,
         CASE WHEN c0.n IS NOT NULL THEN wl.word IS NOT NULL ELSE true END AS in_official_wordlist
  FROM c0 FULL JOIN c1 USING (word, source_type, exam_id) LEFT JOIN wl USING (word)""")
def _(spark, sf):
    keys = ["word", "source_type", "exam_id"]
    columns = [*keys, "frequency", "word_level", "in_official_wordlist"]
    early, late = _halves(spark, sf)
    old = C.label_counts(K.file_counts(early), I.wordlist(spark, sf).select("word", "word_level")).select(columns)
    new = (K.file_counts(late)
           .withColumn("word_level", F.lit(9)).withColumn("in_official_wordlist", F.lit(True)).select(columns))
    return _upserted(old, new, keys, [F.desc("frequency")], update_cols=["frequency"])


# Listed words are to have a level of 1 to 9 and to be in the benchmark; the second delivery has others.
_GATED = """
  WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark),
  c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations)"""


def _gated(spark, sf):
    listed = K.spaced_tokens(I.table(spark, sf, "benchmark").select("text")).distinct()
    first = _word_rows(spark, sf, "benchmark", 6).select("word", "word_level")
    second = _word_rows(spark, sf, "conversations", 99).select("word", (F.col("word_level") + 3).alias("word_level"))
    own = KeyedTable(spark, scratch_path(spark, "gated"), first.schema, ["word"], rules={"word_level": F.col("word_level").between(1, 9)},
                     parents={"benchmark": (listed, ["word"])})
    own.replace(first)
    try:
        own.upsert(second, [F.asc("word_level")])
    except Refused:
        pass
    return own


@query("gated_load", _GATED + " SELECT word, CAST(least(6, length(word)) AS INTEGER) AS word_level FROM b")
def _(spark, sf):
    """A delivery with bad rows is refused as a whole: the version before stays the current one."""
    return _gated(spark, sf).read()


# Rows are checked as they would be stored: old rows of the buckets that the delivery falls into are among them, and meet the rules.
@query("gated_rows_set_aside", _GATED + """
  SELECT word, CAST(length(word) + 3 AS INTEGER) AS word_level,
         concat_ws(',', CASE WHEN length(word) + 3 > 9 THEN 'word_level' END, CASE WHEN word NOT IN (SELECT word FROM b) THEN 'benchmark' END) AS broken
  FROM c WHERE length(word) + 3 > 9 OR word NOT IN (SELECT word FROM b)""")
def _(spark, sf):
    return _gated(spark, sf).set_aside().withColumn("broken", F.array_join("broken", ","))


# --- checks ---------------------------------------------------------------------------------------------

# Rows that break rules, added to the tables.
_BAD = {"wl": [("the", 12), ("zz", 0)], "src": [("src1", "en", 3), ("nowhere", "video", 12)],
        "freq": [("the", "src1", "en"), ("the", "lost", "fr")], "sent": [("lost", "fr", "x"), ("lost", "fr", "x")]}
_COLUMNS = {"wl": "word, word_level", "src": "exam_id, source_type, exam_level", "freq": "word, exam_id, source_type",
            "sent": "exam_id, source_type, sentence"}


@query("constraint_violations", sql("freq src sent wl", "") + "".join(
    f", {name}2 AS (SELECT {_COLUMNS[name]} FROM {name} UNION ALL VALUES {', '.join(map(repr, rows))})" for name, rows in _BAD.items()) + """
  SELECT 'wordlist.word_level' AS check_name, count(*) FILTER (word_level NOT BETWEEN 1 AND 9) AS violations FROM wl2
  UNION ALL SELECT 'wordlist.word', count(*) FROM (SELECT word FROM wl2 GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'exam_sources.exam_level', count(*) FILTER (exam_level NOT BETWEEN 1 AND 9) FROM src2
  UNION ALL SELECT 'exam_sources.source_type', count(*) FILTER (source_type NOT IN ('de', 'en', 'es')) FROM src2
  UNION ALL SELECT 'exam_sources.key', count(*) FROM (SELECT 1 FROM src2 GROUP BY exam_id, source_type HAVING count(*) > 1)
  UNION ALL SELECT 'word_frequencies.source_type', count(*) FILTER (source_type NOT IN ('de', 'en', 'es')) FROM freq2
  UNION ALL SELECT 'word_frequencies.key', count(*) FROM (SELECT 1 FROM freq2 GROUP BY word, exam_id, source_type HAVING count(*) > 1)
  UNION ALL SELECT 'word_frequencies.source', count(*) FROM freq2 WHERE (exam_id, source_type) NOT IN (SELECT (exam_id, source_type) FROM src2)
  UNION ALL SELECT 'exam_sentences.source_type', count(*) FILTER (source_type NOT IN ('de', 'en', 'es')) FROM sent2
  UNION ALL SELECT 'exam_sentences.key', count(*) FROM (SELECT 1 FROM sent2 GROUP BY exam_id, source_type, sentence HAVING count(*) > 1)
  UNION ALL SELECT 'exam_sentences.source', count(*) FROM sent2 WHERE (exam_id, source_type) NOT IN (SELECT (exam_id, source_type) FROM src2)""")
def _(spark, sf):
    stored = I.corpus(spark, sf)
    tables_ = {"wl": stored.wordlist, "src": stored.sources, "freq": stored.frequencies, "sent": stored.sentences}
    rows = {name: (df := tables_[name].select(*_COLUMNS[name].split(", "))).unionByName(spark.createDataFrame(_BAD[name], df.schema))
            for name in _BAD}
    return checks.constraint_violations(rows["wl"], rows["src"], rows["freq"], rows["sent"], ("de", "en", "es"))


@query("sanity_checks", sql("counts", """
  SELECT count(*) FILTER (length(word) = 0) AS empty_words, count(*) FILTER (frequency <= 0) AS non_positive,
         count(DISTINCT exam_id) AS exams FROM counts"""))
def _(spark, sf):
    return checks.sanity(I.counts(spark, sf))


@query("levels_per_word", sql("wl", """
  SELECT word, count(DISTINCT l) AS levels FROM (
    SELECT word, word_level AS l FROM wl UNION ALL
    SELECT word, least(9, length(word)) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations))
  GROUP BY 1 HAVING count(DISTINCT l) > 1"""))
def _(spark, sf):
    both = _word_rows(spark, sf, "benchmark", 6).unionByName(_word_rows(spark, sf, "conversations", 9))
    return checks.level_per_word(both)


# --- written tables and the stream ------------------------------------------------------------------

@query("counts_written_per_source", sql("counts", "SELECT exam_id, exam_level, word, frequency, source_type FROM counts"))
def _(spark, sf):
    path = scratch_path(spark, "per-source")
    sinks.save_per_source(I.counts(spark, sf), path)
    return spark.read.parquet(path)


@query("top_words_as_csv", sql("counts", """
  SELECT word, CAST(sum(frequency) AS VARCHAR) AS total_count FROM counts GROUP BY 1 ORDER BY sum(frequency) DESC, 1 LIMIT 50"""))
def _(spark, sf):
    path = scratch_path(spark, "top-words")
    sinks.save_csv(A.top_overall(I.counts(spark, sf), 50), path)
    return tables.read_csv(spark, path)


@query("sentences_reloaded", sql("sent", "SELECT * FROM sent"))
def _(spark, sf):
    path = scratch_path(spark, "sentences")
    sinks.replace_sentences(I.sentences(spark, sf), path)
    return spark.read.parquet(path)


def _file_counts(rows):
    files = I.as_files(rows).select(F.col("filename").alias("file_id"), "exam_id", "source_type", "text")
    return C.word_counts(K.spaced_tokens(files), ("file_id", "exam_id", "source_type"))


def _follow(spark, sf):
    """Count the documents as they arrive in five parts, which share exams; returns the folder with counts and rollup."""
    landed, folder = scratch_path(spark, "landed"), scratch_path(spark, "stream")
    documents = I.table(spark, sf, "documents")
    # A part has as many files as the scan has tasks, so every core that reads the table also reads a part.
    files = max(1, documents.rdd.getNumPartitions())
    documents.repartition(5 * files).write.parquet(landed)
    words = I.wordlist(spark, sf).select("word", "word_level")
    stream = incremental.follow_files(
        spark, landed, DOCUMENTS, _file_counts, folder, words, files_per_batch=files,
        to_files=lambda rows: I.as_files(rows).select(F.col("filename").alias("file_id")))
    stream.awaitTermination()
    return folder


@query("compacted_rollup", sql("agg", "SELECT * FROM agg"))
def _(spark, sf):
    folder = _follow(spark, sf)
    incremental.compact(spark, folder)
    return incremental.current_rollup(spark, folder)


@query("streamed_counts", sql("freq", """
  SELECT word, source_type, exam_id, frequency, word_level, in_official_wordlist FROM freq"""))
def _(spark, sf):
    return incremental.current_counts(spark, _follow(spark, sf))


@query("streamed_rollup", sql("agg", "SELECT * FROM agg"))
def _(spark, sf):
    return incremental.current_rollup(spark, _follow(spark, sf))
