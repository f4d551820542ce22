"""The supplied tables as a corpus: documents are exam files, benchmark tokens are the word list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexfreq import fixed_values as V
from lexfreq.operators.decompose import PLAIN_RULES, RuleSet
from lexfreq.operators.labels import label_counts_in_full, unmatched_review
from lexfreq.plans import corpus as K
from lexfreq.schemas import SUPPLIED
from lexfreq.session import scratch_path, stored
from lexfreq.sources.sinks import source_rows
from lexfreq.sources.tables import read_parquet, spread
from lexfreq.sources.versions import Versions

LANGUAGES = ("de", "en", "es", "fr")
EXAM_LEVELS = (3, 4)
LATIN = r"\p{L}"
LATIN_ENDS = ".!?;"
WORD = "the"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet", SUPPLIED.get(name))


def as_files(documents: DataFrame) -> DataFrame:
    """exam = source, source type = language, paper level 3 or 4 by the number of the source."""
    number = F.regexp_extract("source", r"src(\d+)", 1).cast("int")
    endings = [".pdf", "_copy.pdf", " Audio.mp3", "-audio.mp3", "(1).pdf", "试卷.pdf", "-exam-paper.PDF"]
    level = F.lit(3) + number % 2
    ending = F.get(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % len(endings)).cast("int"))
    return documents.select(
        "doc_id", F.col("source").alias("exam_id"), F.col("lang").alias("source_type"), level.alias("exam_level"),
        (F.lit(2000) + number).alias("year"),
        F.concat(F.lit("h"), level.cast("string"), F.lpad(number.cast("string"), 4, "0"), F.lit("-"),
                 F.col("doc_id").cast("string"), ending).alias("filename"),
        "text", "n_chars")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return as_files(spread(table(spark, sf, "documents")))


def wordlist(spark: SparkSession, sf: str) -> DataFrame:
    words = K.tokens_to_wordlist(table(spark, sf, "benchmark"))
    return words.withColumn("pinyin", F.regexp_replace("word", "(..)", "$1 "))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return source_rows(files(spark, sf))


def full_wordlist(spark: SparkSession, sf: str) -> DataFrame:
    return (wordlist(spark, sf)
            .withColumn("definition", F.concat(F.lit("def "), F.col("word")))
            .withColumn("definition_th", F.lit(None).cast("string")))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.file_counts(files(spark, sf))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct words of all documents."""
    return K.spaced_tokens(files(spark, sf).select("text")).distinct()


def stored_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts as a table of their own, for queries that read them more than once."""
    return stored(counts(spark, sf), "counts")


def labelled(spark: SparkSession, sf: str, rules: RuleSet = PLAIN_RULES) -> DataFrame:
    return label_counts_in_full(stored_counts(spark, sf), wordlist(spark, sf), rules)


def review(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched_review(labelled(spark, sf), wordlist(spark, sf), segmenter_words(spark, sf),
                            dictionary_words(spark, sf))


REVIEW = ["word", "total_count", "exam_count", "exam_levels_seen", "source_types_seen", "char_length", "likely_noise",
          "all_chars_known", "in_segmenter_dict", "in_dictionary"]


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return K.sentences_of(files(spark, sf), LATIN_ENDS, LATIN, glued=False)


def load(spark: SparkSession, sf: str) -> str:
    """Build the corpus from the tables and write it; the folder it is in."""
    folder = scratch_path(spark, "corpus")
    K.write(K.build(files(spark, sf), full_wordlist(spark, sf), sources(spark, sf), sentences(spark, sf)), folder)
    return folder


_LOADED: dict[tuple, str] = {}


def corpus(spark: SparkSession, sf: str) -> K.Corpus:
    """The stored corpus: the queries on it read its tables, not the texts.

    It is loaded once per application for the files that the tables have, and again when these change or its folder is gone.
    """
    files = tuple(sorted(p for name in ("documents", "benchmark") for p in table(spark, sf, name).inputFiles()))
    key = (spark.sparkContext.applicationId, sf, files)
    if key not in _LOADED or not Versions(spark, _LOADED[key]).current():
        _LOADED[key] = load(spark, sf)
    return K.read(spark, _LOADED[key])


def dictionary_words(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of documents labelled as good."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    chosen = table(spark, sf, "documents").join(good, "doc_id", "left_semi")
    return K.spaced_tokens(chosen.select("text")).distinct()


def segmenter_words(spark: SparkSession, sf: str) -> DataFrame:
    return K.spaced_tokens(table(spark, sf, "conversations").select("text")).distinct()


# The same frames as DuckDB common table expressions.
SQL = {
    "files": """files AS (
      SELECT doc_id, source AS exam_id, lang AS source_type,
             3 + num % 2 AS exam_level, 2000 + num AS year,
             'h' || (3 + num % 2) || lpad(CAST(num AS VARCHAR), 4, '0') || '-' || doc_id ||
               CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '_copy.pdf' WHEN 2 THEN ' Audio.mp3'
                 WHEN 3 THEN '-audio.mp3' WHEN 4 THEN '(1).pdf' WHEN 5 THEN '试卷.pdf' ELSE '-exam-paper.PDF' END AS filename,
             text, n_chars
      FROM (SELECT *, CAST(regexp_extract(source, 'src(\\d+)', 1) AS INTEGER) AS num FROM documents))""",
    "tok": """tok AS (
      SELECT doc_id, exam_id, source_type, exam_level,
             unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM files)""",
    "wl": """wl AS (
      SELECT word, CAST(least(6, length(word)) AS INTEGER) AS word_level,
             regexp_replace(word, '(..)', '\\1 ', 'g') AS pinyin, 'def ' || word AS definition,
             CAST(NULL AS VARCHAR) AS definition_th
      FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark))""",
    "counts": """counts AS (
      SELECT exam_id, source_type, exam_level, word, count(*) AS frequency FROM tok GROUP BY ALL)""",
    "freq": """freq AS (
      SELECT c.word, w.word_level, c.source_type, c.exam_id, c.exam_level, c.frequency,
             w.word IS NOT NULL AS in_official_wordlist
      FROM counts c LEFT JOIN wl w ON c.word = w.word)""",
    "agg": """agg AS (
      SELECT word, word_level, source_type, CAST(sum(frequency) AS BIGINT) AS total_frequency,
             count(DISTINCT exam_id) AS exam_count, bool_or(in_official_wordlist) AS in_official_wordlist
      FROM freq GROUP BY 1, 2, 3
      UNION ALL
      SELECT word, word_level, 'all', CAST(sum(frequency) AS BIGINT), count(DISTINCT exam_id), bool_or(in_official_wordlist)
      FROM freq GROUP BY 1, 2)""",
    "src": """src AS (
      SELECT exam_id, source_type, max(year) AS year, max(exam_level) AS exam_level, min(filename) AS filename
      FROM files GROUP BY 1, 2)""",
    # Splits behind an end mark by putting a line break there first.
    "parts": """parts AS (
      SELECT doc_id, exam_id, source_type, unnest(l) AS part, unnest(range(len(l))) AS pos
      FROM (SELECT *, string_split_regex(regexp_replace(text, '([.!?;])', '\\1' || chr(10), 'g'), '[\\n\\r]+') AS l FROM files))""",
    "cand": """cand AS (
      SELECT doc_id, exam_id, source_type, pos, sentence FROM (
        SELECT *, regexp_replace(regexp_replace(part,
            '__LEAD__', ''),
            '[\\s\\pZ]+$', '') AS sentence
        FROM parts)
      WHERE len(regexp_extract_all(sentence, '\\p{L}')) >= 6 AND length(sentence) <= 80
        AND len(regexp_extract_all(sentence, '\\p{L}')) / length(sentence) >= 0.6
        AND NOT regexp_matches(sentence, '(?:^|[\\s\\pZ，,。.])[A-EＡ-Ｅ](?:[\\s\\pZ，,。.]|$)|[（(][\\s\\pZ]*[）)]'))""",
    "sent": """sent AS (
      SELECT exam_id, source_type, sentence FROM (SELECT DISTINCT exam_id, source_type, sentence FROM cand)
      WHERE sentence NOT IN (SELECT sentence FROM cand GROUP BY 1 HAVING count(DISTINCT exam_id) >= 3))""",
    "vocab": "vocab AS (SELECT DISTINCT word FROM tok)",
    # Levels by the rules without character classes: doubled single, XX, AABB, two listed words.
    "composed": """unlisted AS MATERIALIZED (SELECT word FROM vocab WHERE word NOT IN (SELECT word FROM wl)),
    splits AS MATERIALIZED (
      SELECT word, i, left(word, i) AS a, substr(word, i + 1) AS b
      FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i, (SELECT max(length(word)) FROM wl) AS longest FROM unlisted WHERE length(word) >= 4)
      WHERE i <= longest AND length(word) - i <= longest),
    halves AS MATERIALIZED (
      SELECT s.word, arg_min(greatest(a.word_level, b.word_level), s.i) AS lv
      FROM splits s JOIN wl a ON a.word = s.a JOIN wl b ON b.word = s.b GROUP BY 1),
    shaped AS MATERIALIZED (
      SELECT word, CASE WHEN length(word) = 1 THEN word || word END AS doubled,
             CASE WHEN length(word) = 2 AND word[1] = word[2] THEN word[1] END AS single,
             CASE WHEN length(word) = 4 AND word[1] = word[2] AND word[3] = word[4] THEN word[1] || word[3] END AS base FROM unlisted),
    composed AS (
      SELECT word, decomposed_level, match_pattern FROM (
        SELECT u.word, coalesce(d.word_level, x.word_level, ab.word_level, h.lv) AS decomposed_level,
          CASE WHEN u.doubled IS NOT NULL THEN 'single_char_via_doubled_form'
               WHEN x.word_level IS NOT NULL THEN 'reduplication'
               WHEN ab.word_level IS NOT NULL THEN 'aabb_reduplication' ELSE 'two_word_compound' END AS match_pattern
        FROM shaped u LEFT JOIN wl d ON d.word = u.doubled LEFT JOIN wl x ON x.word = u.single
        LEFT JOIN wl ab ON ab.word = u.base LEFT JOIN halves h ON h.word = u.word)
      WHERE decomposed_level IS NOT NULL)""",
    "lab": """lab AS (
      SELECT c.*, w.word_level, p.match_pattern, coalesce(w.word_level, p.decomposed_level) AS effective_level,
             CASE WHEN w.word_level IS NOT NULL THEN 'direct' WHEN p.decomposed_level IS NOT NULL THEN 'decomposed'
                  ELSE 'unmatched' END AS match_type
      FROM counts c LEFT JOIN wl w ON w.word = c.word LEFT JOIN composed p ON p.word = c.word)""",
    "dict": """dict AS (
      SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word
      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))""",
    "segd": """segd AS (
      SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM conversations)""",
    "review": """known AS (
      SELECT word, bool_and(ch IN (SELECT word FROM wl WHERE length(word) = 1)) AS all_chars_known
      FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM vocab) GROUP BY 1),
    review AS (
      SELECT u.*, CAST(length(u.word) AS INTEGER) AS char_length, total_count <= 2 AND exam_count = 1 AS likely_noise, k.all_chars_known,
             u.word IN (SELECT word FROM segd) AS in_segmenter_dict, u.word IN (SELECT word FROM dict) AS in_dictionary
      FROM (SELECT word, CAST(sum(frequency) AS BIGINT) AS total_count, count(DISTINCT exam_id) AS exam_count,
                   string_agg(DISTINCT CAST(exam_level AS VARCHAR), ',' ORDER BY CAST(exam_level AS VARCHAR)) AS exam_levels_seen,
                   string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types_seen
            FROM lab WHERE match_type = 'unmatched' GROUP BY 1) u JOIN known k USING (word))""",
}

_BLANK = r"[\s\pZ]"
_LEAD = "|".join([
    rf"{_BLANK}+", V.EXAMPLE_LEAD.replace(r"\s", r"\s\pZ"),
    *(rf"[{digits}]{{1,3}}{_BLANK}*[{V.NUMBER_SEPARATORS}]" for digits in (V.DIGITS, V.HAN_NUMBERS)),
    rf"[{V.OPTION_LETTERS}][\s\pZ,，．.]", rf"[{V.LEAD_CLUSTER}]+"])
SQL["cand"] = SQL["cand"].replace("__LEAD__", f"^(?:{_LEAD})+".replace("'", "''"))

_NEEDS = {
    "tok": ["files"], "counts": ["tok"], "freq": ["counts", "wl"], "agg": ["freq"], "src": ["files"],
    "parts": ["files"], "cand": ["parts"], "sent": ["cand"], "vocab": ["tok"], "composed": ["vocab", "wl"],
    "lab": ["counts", "wl", "composed"], "review": ["lab", "segd", "dict", "wl", "vocab"],
}


def sql(uses: str, body: str) -> str:
    """The query with the named expressions, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    return ("WITH " + ",\n".join(SQL[n] for n in order) + "\n" if order else "") + body.strip()
