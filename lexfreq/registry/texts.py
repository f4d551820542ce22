"""Cleaning, sentences, segmentation and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfreq.functions import quality, reading, text as X
from lexfreq.operators import cleaning, counts as C, segmentation, sentences as S
from lexfreq.plans import corpus as K
from lexfreq.registry import inputs as I
from lexfreq.registry.base import query
from lexfreq.registry.inputs import sql

CLAUSE_ENDS = ",.!?;"
LISTENING = "en"


@query("repeats_collapsed")
def _(spark, sf):
    cleaned = cleaning.collapse_repeats(F.col("text"))
    return I.files(spark, sf).select("doc_id", cleaned.alias("text_clean")).select(
        "doc_id", "text_clean", F.length("text_clean").alias("chars_left"))


@query("clause_counts", """
    SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([,.!?;])', '\\1' || chr(1), 'g'), chr(1)),
           lambda c: regexp_matches(c, '[^\\s\\pZ]'))) AS INTEGER) AS clauses FROM documents""")
def _(spark, sf):
    return I.files(spark, sf).select("doc_id", F.size(X.clauses(F.col("text"), CLAUSE_ENDS)).alias("clauses"))


@query("transcripts_deduped")
def _(spark, sf):
    files = I.files(spark, sf).select("doc_id", "source_type", "text")
    return cleaning.dedupe_transcripts(files, F.col("source_type") == LISTENING).select(
        "doc_id", "source_type", "text_clean")


@query("repeat_savings")
def _(spark, sf):
    files = I.files(spark, sf).select("source_type", "text")
    cleaned = cleaning.dedupe_transcripts(files, F.col("source_type") == LISTENING)
    return (cleaned.groupBy("source_type")
            .agg(F.sum(F.length("text")).alias("chars_before"), F.sum(F.length("text_clean")).alias("chars_after"))
            .withColumn("share_removed", 1 - F.try_divide(F.col("chars_after"), F.col("chars_before"))))


_MARKS = ("<p>", "</a>", "&amp;")


@query("marker_counts", "SELECT page_id, CAST(" + " + ".join(
    f"(length(html) - length(replace(html, '{m}', ''))) / {len(m)}" for m in _MARKS) + " AS INTEGER) AS markers FROM pages")
def _(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", X.marker_count(F.col("html"), _MARKS).alias("markers"))


def _spellings(spark, sf):
    """Pairs of spelling and accent-free spelling, as a conversion dictionary."""
    words = K.spaced_tokens(I.files(spark, sf).select("text")).distinct()
    return words.select(F.col("word").alias("traditional"),
                        reading.without_accents(F.col("word")).alias("simplified"))


@query("converted_counts", """
    SELECT word, count(*) AS frequency FROM (
      SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '(\\p{L}+)', 1)) AS word FROM documents) GROUP BY 1""")
def _(spark, sf):
    pairs = cleaning.character_pairs(_spellings(spark, sf))
    converted = cleaning.simplify_text(F.lower("text"), pairs)
    texts = I.files(spark, sf).select(converted.alias("text"))
    return C.word_counts(K.spaced_tokens(texts), keys=())


# Longest first, so that the first alternative that fits is the longest; then any single character.
_PHRASES = """
  WITH ph AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark)
              WHERE length(word) BETWEEN 3 AND 6 AND word <> strip_accents(word)),
  pat AS (SELECT '(?s)' || string_agg(word, '|' ORDER BY length(word) DESC, word) || '|.' AS p FROM ph),
  cut AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), (SELECT p FROM pat)),
                 lambda t: CASE WHEN length(t) > 1 THEN reverse(t) ELSE strip_accents(t) END) AS parts FROM documents)
  SELECT doc_id, array_to_string(parts, '') AS converted FROM cut"""


@query("phrases_converted", _PHRASES)
def _(spark, sf):
    """Listed phrases are turned round as wholes, all other characters lose their accents."""
    phrases = (K.spaced_tokens(I.table(spark, sf, "benchmark").select("text")).distinct()
               .filter(F.length("word").between(3, 6) & (F.col("word") != reading.without_accents(F.col("word"))))
               .select(F.col("word").alias("traditional"), F.reverse("word").alias("simplified")))
    listed = cleaning.phrase_pairs(phrases, cleaning.character_pairs(_spellings(spark, sf)))
    texts = I.files(spark, sf).select("doc_id", F.lower("text").alias("text"))
    return cleaning.convert_phrases(texts, listed, output="converted").select("doc_id", "converted")


@query("converted_wordlist", sql("wl", """
    SELECT strip_accents(word) AS word, min(word_level) AS word_level FROM (
      SELECT word, word_level FROM wl
      UNION ALL SELECT word, CAST(least(9, length(word)) AS INTEGER)
      FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations)) GROUP BY 1"""))
def _(spark, sf):
    spellings = _spellings(spark, sf)
    more = I.segmenter_words(spark, sf).withColumn("word_level", F.least(F.lit(9), F.length("word")))
    listed = I.wordlist(spark, sf).select("word", "word_level").unionByName(more)
    converted = cleaning.simplify_words(listed, spellings, cleaning.character_pairs(spellings))
    return cleaning.lowest_level(converted)


# The best path from the end of each run to its start: values and paths of all later positions are carried along.
_SEGMENTED = sql("files", "").replace("WITH ", "WITH RECURSIVE ", 1) + """,
  lex AS (SELECT word, count(*) AS weight FROM (
    SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark) GROUP BY 1),
  size AS (SELECT CAST(sum(weight) AS DOUBLE) AS total, max(length(word)) AS longest FROM lex),
  runs AS MATERIALIZED (SELECT exam_id, source_type, run, count(*) AS n FROM (
    SELECT exam_id, source_type, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS run FROM files) GROUP BY ALL),
  own AS MATERIALIZED (SELECT DISTINCT run FROM runs),
  grams AS (SELECT run, s, z, substr(run, s, z) AS g
            FROM (SELECT run, s, unnest(range(1, least(longest, length(run) - s + 1) + 1)) AS z
                  FROM (SELECT run, unnest(range(1, length(run) + 1)) AS s FROM own), size)),
  steps AS MATERIALIZED (SELECT run, s, list({'w': CAST(round((coalesce(ln(CAST(weight AS DOUBLE)), 0.0) - ln(total)) * 1000000) AS BIGINT), 'z': z, 'g': g}) AS o
            FROM grams LEFT JOIN lex ON g = word, size WHERE z = 1 OR weight IS NOT NULL GROUP BY run, s),
  walk AS (
    SELECT run, CAST(length(run) + 1 AS BIGINT) AS place, [CAST(0 AS BIGINT)] AS vals, [CAST([] AS VARCHAR[])] AS paths FROM own
    UNION ALL
    SELECT run, place - 1, list_prepend(best.v, vals), list_prepend(list_prepend(best.g, paths[best.z]), paths) FROM (
      SELECT walk.*, list_max([{'v': x.w + vals[x.z], 'z': x.z, 'g': x.g} FOR x IN o]) AS best
      FROM walk JOIN steps ON steps.run = walk.run AND steps.s = walk.place - 1))
  SELECT exam_id, source_type, word, CAST(sum(n) AS BIGINT) AS frequency
  FROM (SELECT run, unnest(paths[1]) AS word FROM walk WHERE place = 1) JOIN runs USING (run) GROUP BY ALL"""


@query("segmented_counts", _SEGMENTED)
def _(spark, sf):
    """Words treated as unspaced runs and cut into listed words."""
    lexicon = C.word_counts(K.spaced_tokens(I.table(spark, sf, "benchmark").select("text")), keys=(), output="weight")
    texts = I.files(spark, sf).select("exam_id", "source_type", F.lower("text").alias("text"))
    return segmentation.segmented_tokens(texts, lexicon, I.LATIN)


def _found(spark, sf):
    files = I.files(spark, sf).select("doc_id", "exam_id", "source_type", "text")
    return S.candidates(files, "text", I.LATIN_ENDS, I.LATIN, glued=False)


@query("sentence_candidates", sql("cand", "SELECT doc_id, exam_id, source_type, sentence FROM cand"))
def _(spark, sf):
    return _found(spark, sf).select("doc_id", "exam_id", "source_type", "sentence")


@query("sentences_per_file", sql("cand", """
    SELECT doc_id, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INTEGER) AS ordinal
    FROM cand GROUP BY doc_id, sentence"""))
def _(spark, sf):
    first = S.per_file(_found(spark, sf), ["doc_id"])
    return S.numbered(first, ["doc_id"]).select("doc_id", "sentence", "ordinal")


@query("boilerplate_sentences", sql("cand", """
    SELECT sentence, count(DISTINCT exam_id) AS exam_count FROM cand GROUP BY 1 HAVING count(DISTINCT exam_id) >= 3"""))
def _(spark, sf):
    return S.boilerplate(_found(spark, sf))


@query("exam_sentences", sql("sent", "SELECT * FROM sent"))
def _(spark, sf):
    return I.sentences(spark, sf)


@query("distinct_sentences", sql("sent", "SELECT DISTINCT sentence FROM sent"))
def _(spark, sf):
    return I.sentences(spark, sf).select("sentence").distinct()


@query("text_previews", """
    SELECT doc_id, substr(text, 1, 400) AS head, substr(text, CAST(length(text) // 2 AS BIGINT) + 1, 400) AS middle
    FROM documents""".replace("CAST(length(text) // 2 AS BIGINT)", "CAST(floor(length(text) / 2) AS BIGINT)"))
def _(spark, sf):
    return I.files(spark, sf).select("doc_id", X.preview(F.col("text")).alias("head"),
                                     X.middle_preview(F.col("text")).alias("middle"))


# --- extraction quality ----------------------------------------------------------------------

_BAR = r"\|"
_QUALITY = """
  q AS (SELECT doc_id, exam_level, length(text) AS n, CAST(len(string_split(text, chr(10))) AS INTEGER) AS pages, text,
               CASE WHEN NOT regexp_matches(text, '[^\\s\\pZ]') THEN 'empty'
                    WHEN length(text) / greatest(len(string_split(text, chr(10))), 1) < 150 THEN 'sparse'
                    WHEN len(regexp_extract_all(text, '\\|')) > 10 THEN 'cid' END AS reason FROM files),
  noted AS (SELECT *, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'empty' THEN 'ocr_ok' ELSE reason || '_then_ocr_ok' END AS notes FROM q),
  methods AS (SELECT *, CASE WHEN notes = 'ok' THEN 'pdfplumber' WHEN notes = 'ocr_ok' THEN 'OCR (scanned)'
                  WHEN contains(notes, 'sparse') THEN 'OCR (sparse fix)' ELSE 'OCR (cid fix)' END AS method FROM noted)"""


def _with_quality(body: str) -> str:
    return sql("files", "") + "," + _QUALITY + body


def extractions(spark, sf):
    """Files with pages (paragraphs), size, reason and note."""
    text, pages = F.col("text"), F.size(F.split("text", "\n"))
    reason = quality.ocr_reason(text, pages, artefact=_BAR)
    return I.files(spark, sf).select(
        "doc_id", "exam_id", "exam_level", "source_type", "filename", "text",
        F.length("text").alias("text_length"), pages.alias("pages"), F.col("n_chars").alias("size_mb"),
        reason.alias("reason"), quality.ocr_note(reason).alias("notes"))


@query("extraction_quality", _with_quality(" SELECT doc_id, reason, notes, method FROM methods"))
def _(spark, sf):
    return extractions(spark, sf).select("doc_id", "reason", "notes",
                                         quality.method_label(F.col("notes")).alias("method"))


@query("note_counts", _with_quality(" SELECT notes, count(*) AS files FROM noted GROUP BY 1"))
def _(spark, sf):
    from lexfreq.plans.analysis import note_counts
    return note_counts(extractions(spark, sf))


@query("method_summary", _with_quality("""
  SELECT method, count(*) AS files, avg(n) AS avg_chars, avg(pages) AS avg_pages,
         CAST(sum(CAST(round_even(n / greatest(pages, 1), 1) AS DECIMAL(18, 1))) AS DOUBLE) / count(*) AS avg_chars_per_page,
         avg(f.n_chars) AS avg_mb
  FROM methods m JOIN files f ON m.doc_id = f.doc_id GROUP BY 1"""))
def _(spark, sf):
    from lexfreq.plans.analysis import method_summary
    return method_summary(extractions(spark, sf))


@query("method_by_exam_level", _with_quality("""
  SELECT method, count(*) FILTER (exam_level = 3) AS exam_level_3, count(*) FILTER (exam_level = 4) AS exam_level_4,
         count(*) FILTER (exam_level NOT IN (3, 4) OR exam_level IS NULL) AS exam_level_other
  FROM methods GROUP BY 1"""))
def _(spark, sf):
    from lexfreq.plans.analysis import method_by_exam_level
    return method_by_exam_level(extractions(spark, sf), I.EXAM_LEVELS)


_SECTIONS = "[A-Z][a-z]+[.]"
_NUMBERS = "([0-9]{1,2})"


@query("full_exam_checks", sql("files", f"""
    SELECT doc_id, n_sections, max_q, q_coverage, CASE WHEN issues = '' THEN 'OK' ELSE issues END AS issues FROM (
      SELECT doc_id, n_sections, max_q, round_even(max_q / expected * 100, 1) AS q_coverage,
             concat_ws('; ', CASE WHEN n_sections < 3 THEN 'sections=' || n_sections || '/3' END,
                       CASE WHEN max_q < expected * 0.8 THEN 'max_q=' || max_q || '/' || expected END) AS issues
      FROM (SELECT doc_id, CASE exam_level WHEN 3 THEN 40 ELSE 45 END AS expected,
                   CAST(len(list_distinct(regexp_extract_all(text, '{_SECTIONS}'))) AS INTEGER) AS n_sections,
                   coalesce(list_max(list_filter(list_transform(regexp_extract_all(text, '{_NUMBERS}', 1),
                     lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 60)), 0) AS max_q FROM files))"""))
def _(spark, sf):
    checks = quality.full_exam_checks(F.col("text"), F.col("exam_level"), section=_SECTIONS, question=_NUMBERS)
    return I.files(spark, sf).select("doc_id", *[c.alias(n) for n, c in checks.items()])


_SKILLS = (("has_listening", "the", "[Tt]he"), ("has_reading", "und", "[Uu]nd"), ("has_writing", "que", "[Qq]ue"))


@query("instruction_checks", """
    SELECT doc_id, has_notice, has_listening, has_reading, has_writing, notice_items,
           CASE WHEN issues = '' THEN 'OK' ELSE issues END AS issues FROM (
      SELECT *, concat_ws('; ', CASE WHEN NOT has_notice THEN 'no notice header' END, CASE WHEN missing <> '' THEN 'missing: ' || missing END,
                          CASE WHEN notice_items < 3 THEN 'notice_items=' || notice_items || '/3' END) AS issues FROM (
        SELECT *, concat_ws(',', CASE WHEN NOT has_listening THEN 'the' END, CASE WHEN NOT has_reading THEN 'und' END,
                            CASE WHEN NOT has_writing THEN 'que' END) AS missing FROM (
          SELECT doc_id, regexp_matches(text, 'A[rn]') AS has_notice, regexp_matches(text, '[Tt]he') AS has_listening,
                 regexp_matches(text, '[Uu]nd') AS has_reading, regexp_matches(text, '[Qq]ue') AS has_writing,
                 CAST(len(list_distinct(regexp_extract_all(text, '[abc][,.]'))) AS INTEGER) AS notice_items FROM documents)))""")
def _(spark, sf):
    checks = quality.instruction_checks(F.col("text"), notice="A[rn]", skills=_SKILLS, item="[abc][,.]",
                                        notice_name="notice")
    return I.files(spark, sf).select("doc_id", *[c.alias(n) for n, c in checks.items()])
