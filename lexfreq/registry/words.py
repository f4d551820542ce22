"""Counts, rollup and the word queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexfreq.functions import text as X
from lexfreq.operators import counts as C
from lexfreq.plans import corpus as K, word_queries as Q
from lexfreq.registry import inputs as I
from lexfreq.registry.base import query
from lexfreq.registry.inputs import sql
from lexfreq.operators.decompose import PLAIN_RULES
from lexfreq.schemas import TABLES
from lexfreq.sources.sinks import frequency_rows

_AGGREGATE = ["word", "word_level", "source_type", "total_frequency", "exam_count", "in_official_wordlist"]


@query("document_scan", sql("", "SELECT doc_id, lang, source, n_chars FROM documents"))
def _(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("token_counts", sql("tok", "SELECT doc_id, count(*) AS tokens FROM tok GROUP BY 1"))
def _(spark, sf):
    tokens = X.tokens(F.col("text"))
    return (I.files(spark, sf).select("doc_id", F.size(tokens).cast("long").alias("tokens"))
            .filter("tokens > 0"))


_MODES = """
SELECT mode, word, count(*) AS frequency FROM (
  SELECT 'all' AS mode, t AS word FROM raw WHERE regexp_full_match(t, '[\\p{L}]+')
  UNION ALL SELECT 'any', t FROM raw WHERE regexp_matches(t, '[\\p{L}]')) GROUP BY 1, 2"""


@query("script_filter_modes",
       "WITH raw AS (SELECT unnest(string_split(text, ' ')) AS t FROM documents)" + _MODES)
def _(spark, sf):
    words = F.split(F.col("text"), " ")
    both = F.array(*[F.struct(F.lit(mode).alias("mode"), X.keep_script(F.col("words"), I.LATIN, mode).alias("kept"))
                     for mode in ("all", "any")])
    return (I.table(spark, sf, "documents").select(words.alias("words"))
            .select(F.inline(both)).select("mode", F.explode("kept").alias("word"))
            .groupBy("mode", "word").agg(F.count("*").alias("frequency")))


@query("counts_per_file", sql("counts", "SELECT * FROM counts"))
def _(spark, sf):
    return I.counts(spark, sf)


@query("counts_overall", sql("tok", "SELECT word, count(*) AS frequency FROM tok GROUP BY 1"))
def _(spark, sf):
    return C.word_counts(K.spaced_tokens(I.files(spark, sf).select("text")), keys=())


@query("frequency_rows", sql("freq", """
    SELECT word, word_level, source_type, exam_id, frequency, in_official_wordlist FROM freq"""))
def _(spark, sf):
    return frequency_rows(C.label_counts(I.counts(spark, sf), I.wordlist(spark, sf)
                                         .select("word", "word_level")))


@query("counts_with_repeated_list", sql("counts wl", "") + """,
    twice AS (SELECT word, word_level FROM wl UNION ALL
      SELECT word, CAST(least(9, length(word) + 1) AS INTEGER) FROM (
        SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations)),
    lowest AS (SELECT word, min(word_level) AS word_level FROM twice GROUP BY 1)
    SELECT c.word, l.word_level, c.source_type, c.exam_id, c.frequency, l.word IS NOT NULL AS in_official_wordlist
    FROM counts c LEFT JOIN lowest l USING (word)""")
def _(spark, sf):
    """A word list with several rows, and levels, for many words."""
    more = I.segmenter_words(spark, sf).select("word", F.least(F.lit(9), F.length("word") + 1).alias("word_level"))
    listed = I.wordlist(spark, sf).select("word", "word_level").unionByName(more)
    return frequency_rows(C.label_counts(I.counts(spark, sf), listed))


@query("rollup", sql("agg", "SELECT * FROM agg"))
def _(spark, sf):
    return I.corpus(spark, sf).aggregates.select(*_AGGREGATE)


@query("corpus_written", sql("freq agg src sent wl", """
    SELECT 'exam_sources' AS table_name, count(*) AS table_rows FROM src
    UNION ALL SELECT 'exam_sentences', count(*) FROM sent UNION ALL SELECT 'frequency_aggregates', count(*) FROM agg
    UNION ALL SELECT 'word_frequencies', count(*) FROM freq UNION ALL SELECT 'wordlist', count(*) FROM wl"""))
def _(spark, sf):
    """The whole load: counts, labels, rollup and sentences, written as the five tables."""
    paths = K.table_paths(spark, I.load(spark, sf))
    counted = [spark.read.parquet(paths[name]).agg(F.count("*").alias("table_rows"))
               .select(F.lit(name).alias("table_name"), "table_rows") for name in TABLES]
    return reduce(DataFrame.unionByName, counted)


_TOP = """
SELECT a.word, a.word_level, a.word_level AS effective_level, a.source_type, a.total_frequency, a.exam_count, a.in_official_wordlist, w.pinyin
FROM agg a LEFT JOIN wl w ON a.word = w.word WHERE {where}
ORDER BY total_frequency DESC, a.word LIMIT {limit}"""


@query("top_words", sql("agg", _TOP.format(where="source_type = 'all'", limit=50)))
def _(spark, sf):
    return Q.top_words(I.corpus(spark, sf), source_types=I.LANGUAGES)


@query("top_words_effective_level", sql("lab", """
    SELECT word, word_level, effective_level, 'all' AS source_type, CAST(sum(frequency) AS BIGINT) AS total_frequency,
           count(DISTINCT exam_id) AS exam_count, word_level IS NOT NULL AS in_official_wordlist,
           CASE WHEN word_level IS NOT NULL THEN regexp_replace(word, '(..)', '\\1 ', 'g') END AS pinyin
    FROM lab GROUP BY ALL ORDER BY total_frequency DESC, word LIMIT 200"""))
def _(spark, sf):
    """Served rows with the level that decomposition gives to words that are not listed."""
    built = K.build(I.files(spark, sf), I.full_wordlist(spark, sf), I.sources(spark, sf), rules=PLAIN_RULES)
    return Q.top_words(built, limit=200, source_types=I.LANGUAGES)


@query("top_words_level", sql("agg", _TOP.format(where="source_type = 'all' AND a.word_level = 4", limit=20)))
def _(spark, sf):
    return Q.top_words(I.corpus(spark, sf), word_level=4, limit=20, source_types=I.LANGUAGES)


@query("top_words_source", sql("agg", _TOP.format(where="source_type = 'fr'", limit=10000)))
def _(spark, sf):
    return Q.top_words(I.corpus(spark, sf), source_type="fr", limit=10000, source_types=I.LANGUAGES)


_LIVE = """
SELECT f.word, f.word_level, f.word_level AS effective_level,
       CASE WHEN count(DISTINCT f.source_type) > 1 THEN 'all' ELSE min(f.source_type) END AS source_type,
       CAST(sum(frequency) AS BIGINT) AS total_frequency, count(DISTINCT f.exam_id) AS exam_count,
       bool_or(in_official_wordlist) AS in_official_wordlist, max(w.pinyin) AS pinyin
FROM freq f JOIN src s ON f.exam_id = s.exam_id AND f.source_type = s.source_type
LEFT JOIN wl w ON f.word = w.word WHERE {where} GROUP BY 1, 2 ORDER BY total_frequency DESC, f.word LIMIT {limit}"""
_LIVE_TOTAL = """
SELECT count(DISTINCT f.word) AS total_count
FROM freq f JOIN src s ON f.exam_id = s.exam_id AND f.source_type = s.source_type WHERE {where}"""


@query("top_words_exam_level", sql("freq src", _LIVE.format(where="s.exam_level = 3", limit=50)))
def _(spark, sf):
    return Q.top_words(I.corpus(spark, sf), exam_level=3, source_types=I.LANGUAGES)


@query("top_words_exams", sql("freq src", _LIVE.format(
    where="f.exam_id IN ('src1', 'src2', 'src7') AND f.source_type = 'en' AND f.word_level = 5", limit=100)))
def _(spark, sf):
    return Q.top_words(I.corpus(spark, sf), word_level=5, exam_ids=["src1", "src2", "src7"], source_type="en",
                       limit=100, source_types=I.LANGUAGES)


@query("top_words_total", sql("agg", "SELECT count(*) AS total_count FROM agg WHERE source_type = 'all'"))
def _(spark, sf):
    return Q.top_words_total(I.corpus(spark, sf), source_types=I.LANGUAGES)


@query("top_words_total_exam_level", sql("freq src", _LIVE_TOTAL.format(where="s.exam_level = 4")))
def _(spark, sf):
    return Q.top_words_total(I.corpus(spark, sf), exam_level=4, source_types=I.LANGUAGES)


@query("top_words_total_exams", sql("freq src", _LIVE_TOTAL.format(where="f.exam_id IN ('src1', 'src2')")))
def _(spark, sf):
    return Q.top_words_total(I.corpus(spark, sf), exam_ids=["src1", "src2"], source_types=I.LANGUAGES)


@query("exams", sql("src", """
    SELECT exam_id, max(exam_level) AS exam_level, max(year) AS year,
           string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM src GROUP BY 1"""))
def _(spark, sf):
    return Q.list_exams(I.sources(spark, sf)).withColumn("source_types", F.array_join("source_types", ","))


_SIDES = """
SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY total_frequency DESC, word) AS INTEGER) AS side_rank,
       word, word_level, total_frequency, exam_count, pinyin
FROM ({inner}) QUALIFY side_rank <= {limit}"""
_COMPARE = _SIDES.replace("{inner}", """
  SELECT 'not_in_official_wordlist' AS side, word, word_level, total_frequency, exam_count, CAST(NULL AS VARCHAR) AS pinyin
  FROM agg WHERE NOT in_official_wordlist AND {where}
  UNION ALL
  SELECT 'in_official_wordlist', a.word, a.word_level, total_frequency, exam_count, w.pinyin
  FROM agg a JOIN wl w ON a.word = w.word WHERE in_official_wordlist AND {where}""")
_COMPARE_LIVE = _SIDES.replace("{inner}", """
  SELECT CASE WHEN in_official_wordlist THEN 'in_official_wordlist' ELSE 'not_in_official_wordlist' END AS side,
         f.word, f.word_level, CAST(sum(frequency) AS BIGINT) AS total_frequency, count(DISTINCT f.exam_id) AS exam_count,
         CASE WHEN in_official_wordlist THEN min(w.pinyin) END AS pinyin
  FROM freq f JOIN src s ON f.exam_id = s.exam_id AND f.source_type = s.source_type LEFT JOIN wl w ON f.word = w.word
  WHERE {where} GROUP BY f.word, f.word_level, in_official_wordlist""")


@query("compare_words", sql("agg", _COMPARE.format(where="source_type = 'all'", limit=50)))
def _(spark, sf):
    return Q.compare_words(I.corpus(spark, sf), source_types=I.LANGUAGES)


@query("compare_words_source", sql("agg", _COMPARE.format(where="source_type = 'en'", limit=500)))
def _(spark, sf):
    return Q.compare_words(I.corpus(spark, sf), source_type="en", limit=500, source_types=I.LANGUAGES)


@query("compare_words_exam", sql("freq src", _COMPARE_LIVE.format(where="f.exam_id = 'src5'", limit=50)))
def _(spark, sf):
    return Q.compare_words(I.corpus(spark, sf), exam_id="src5", source_types=I.LANGUAGES)


@query("compare_words_exam_level", sql("freq src", _COMPARE_LIVE.format(
    where="s.exam_level = 4 AND f.source_type = 'en'", limit=100)))
def _(spark, sf):
    return Q.compare_words(I.corpus(spark, sf), exam_level=4, source_type="en", limit=100,
                           source_types=I.LANGUAGES)


@query("word_occurrences", sql("freq src", f"""
    SELECT f.word, f.word_level, f.source_type, f.exam_id, f.frequency, f.in_official_wordlist, s.year, s.filename
    FROM freq f LEFT JOIN src s ON f.exam_id = s.exam_id AND f.source_type = s.source_type WHERE f.word = '{I.WORD}'"""))
def _(spark, sf):
    return Q.word_occurrences(I.corpus(spark, sf), I.WORD)


@query("word_aggregates", sql("agg", f"SELECT * FROM agg WHERE word = '{I.WORD}'"))
def _(spark, sf):
    return Q.word_aggregates(I.corpus(spark, sf), I.WORD).select(*_AGGREGATE)


@query("word_detail", sql("sent wl", f"""
    SELECT '{I.WORD}' AS word, (SELECT count(*) > 0 FROM wl WHERE word = '{I.WORD}') AS in_wordlist,
           (SELECT pinyin FROM wl WHERE word = '{I.WORD}') AS pinyin,
           (SELECT word_level FROM wl WHERE word = '{I.WORD}') AS word_level,
           (SELECT definition FROM wl WHERE word = '{I.WORD}') AS definition,
           CAST(NULL AS VARCHAR) AS definition_th,
           count(DISTINCT sentence) AS sentence_total, count(DISTINCT (exam_id, source_type)) AS file_total
    FROM sent WHERE contains(sentence, '{I.WORD}')"""))
def _(spark, sf):
    return Q.word_detail(I.corpus(spark, sf), I.WORD)


_ONE_PER_FILE = """
one AS (SELECT exam_id, source_type, sentence FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY exam_id, source_type) AS r
        FROM sent WHERE {where}) WHERE r = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, source_type ORDER BY abs(length(sentence) - 20), sentence) AS r
         FROM one) WHERE r = 1)"""


@query("example_sentences", sql("sent src", "SELECT 1").replace("SELECT 1", "") + "," + _ONE_PER_FILE.format(
    where=f"contains(sentence, '{I.WORD}')") + """
SELECT b.sentence, b.exam_id, b.source_type, s.filename, s.exam_level FROM best b
JOIN src s ON b.exam_id = s.exam_id AND b.source_type = s.source_type
ORDER BY abs(length(b.sentence) - 20), b.sentence LIMIT 10""")
def _(spark, sf):
    return Q.example_sentences(I.corpus(spark, sf), I.WORD)


@query("sentences_with_mark", sql("sent", "SELECT * FROM sent WHERE contains(sentence, '%')"))
def _(spark, sf):
    return Q.sentences_with(I.corpus(spark, sf), "%").select("exam_id", "source_type", "sentence")


@query("all_word_sentence_totals", sql("sent wl", """
    SELECT word, count(DISTINCT sentence) AS sentence_total, count(DISTINCT (exam_id, source_type)) AS file_total
    FROM sent JOIN wl ON contains(sentence, word) GROUP BY 1"""))
def _(spark, sf):
    return Q.sentence_totals_of_all_words(I.corpus(spark, sf))


@query("all_word_examples", sql("sent src wl", "SELECT 1").replace("SELECT 1", "") + """,
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY exam_id, source_type) AS r FROM sent) WHERE r = 1),
pair AS (SELECT word, exam_id, source_type, sentence, abs(length(sentence) - 20) AS distance FROM one JOIN wl ON contains(sentence, word)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, exam_id, source_type ORDER BY distance, sentence) AS r FROM pair) WHERE r = 1)
SELECT word, b.exam_id, b.source_type, CAST(distance AS INTEGER) AS distance, sentence, s.filename, s.exam_level,
       CAST(row_number() OVER (PARTITION BY word ORDER BY distance, sentence) AS INTEGER) AS example_rank
FROM best b JOIN src s ON b.exam_id = s.exam_id AND b.source_type = s.source_type QUALIFY example_rank <= 10""")
def _(spark, sf):
    return Q.examples_of_all_words(I.corpus(spark, sf))


@query("scope_summary", sql("freq src", """
    SELECT CAST(sum(t) AS BIGINT) AS total_occurrences, count(*) FILTER (o) AS official_words,
           count(*) FILTER (NOT o) AS unofficial_words, max(e) AS max_exam_count
    FROM (SELECT word, sum(frequency) AS t, count(DISTINCT exam_id) AS e, bool_or(in_official_wordlist) AS o
          FROM freq WHERE exam_level = 3 GROUP BY 1)"""))
def _(spark, sf):
    return Q.scope_summary(Q.scope_words(I.corpus(spark, sf), exam_level=3))


@query("word_page", sql("agg", """
    SELECT word, word_level, total_frequency FROM agg WHERE source_type = 'all' AND word_level IS NOT NULL
    ORDER BY total_frequency DESC, word LIMIT 10 OFFSET 20"""))
def _(spark, sf):
    items = Q.levelled_words(Q.scope_words(I.corpus(spark, sf)))
    return Q.word_page(Q.ranked_items(items), 3).select("word", "word_level", "total_frequency")


@query("word_page_past_end", sql("agg", """
    SELECT word, word_level, total_frequency FROM
      (SELECT *, row_number() OVER (ORDER BY total_frequency DESC, word) - 1 AS pos, count(*) OVER () AS n
       FROM agg WHERE source_type = 'es' AND word_level IS NOT NULL)
    WHERE floor(pos / 10) = floor((n - 1) / 10)"""))
def _(spark, sf):
    items = Q.levelled_words(Q.scope_words(I.corpus(spark, sf), source_type="es"))
    return Q.word_page(Q.ranked_items(items), 10 ** 6).select("word", "word_level", "total_frequency")


@query("reading_search", sql("agg", """
    SELECT word, word_level, total_frequency FROM
      (SELECT a.*, w.pinyin FROM agg a JOIN wl w USING (word) WHERE source_type = 'all')
    WHERE word_level IS NOT NULL AND (contains(word, 'En T') OR contains(replace(lower(strip_accents(pinyin)), ' ', ''), 'ent'))"""))
def _(spark, sf):
    # Levels and readings are those of the list; words without a level are not searched.
    stored = I.corpus(spark, sf)
    items = Q.scope_words(stored).join(stored.wordlist.select("word", "pinyin"), "word", "left")
    return Q.search_words(items, " En T").select("word", "word_level", "total_frequency")


@query("exam_groups", sql("src", """
    SELECT max(exam_level) AS exam_level, exam_id FROM src WHERE contains(lower(exam_id), 'c1') GROUP BY exam_id"""))
def _(spark, sf):
    return Q.exam_groups(I.sources(spark, sf), " C1")


@query("exam_levels", sql("src", "SELECT DISTINCT exam_level FROM src"))
def _(spark, sf):
    return Q.exam_levels(I.sources(spark, sf))


@query("unlisted_by_exams", sql("freq", """
    SELECT word, count(DISTINCT exam_id) AS exam_count FROM freq WHERE NOT in_official_wordlist
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(spark, sf):
    return Q.unlisted_by_exams(I.corpus(spark, sf))
