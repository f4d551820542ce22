"""Labels, decomposition, coverage and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfreq.operators import labels as L
from lexfreq.operators.decompose import PLAIN_RULES, RuleSet, resolve_words
from lexfreq.plans import analysis as A, coverage as V
from lexfreq.registry import inputs as I
from lexfreq.registry.base import query
from lexfreq.registry.inputs import sql

# Character classes for Latin words, so that every kind of rule has work to do.
LATIN_RULES = RuleSet(ordinal="q", numerals="iou", verbs="tw", pronouns="s", measures="b", functions="adr",
                      name_risk="ml", surnames="aeio", suffixes="ns", silent_suffix="e")


@query("compound_levels", sql("composed", "SELECT word, decomposed_level, match_pattern FROM composed"))
def _(spark, sf):
    return resolve_words(I.vocabulary(spark, sf), I.wordlist(spark, sf), PLAIN_RULES)


# The same rules as SQL: every remainder a rule may ask for, then the levels of remainders from short to long.
_HIGHEST = "CASE WHEN len(list_filter({0}, lambda x: x IS NULL)) = 0 THEN list_max({0}) END"
_BOTH = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END"
_R = LATIN_RULES
_AFFIXED = sql("vocab wl", "").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  listed AS MATERIALIZED (SELECT word, min(word_level) AS lv FROM wl GROUP BY 1),
  letters AS MATERIALIZED (SELECT map_from_entries(list((word, lv))) AS m FROM listed WHERE length(word) = 1),
  need AS (
    SELECT word AS t FROM vocab
    UNION
    SELECT c FROM (SELECT unnest([
        CASE WHEN regexp_matches(t, '^{_R.ordinal}[{_R.numerals}]') THEN regexp_replace(t, '^{_R.ordinal}[{_R.numerals}]+', '') END,
        CASE WHEN regexp_matches(t, '^[{_R.numerals}]') THEN regexp_replace(t, '^[{_R.numerals}]+', '') END,
        CASE WHEN contains('{_R.prefixes}', t[1]) THEN substr(t, 2) END,
        CASE WHEN contains('{_R.back}', right(t, 1)) THEN left(t, length(t) - 1) END]) AS c
      FROM need WHERE length(t) > 1) WHERE c <> ''),
  splits AS MATERIALIZED (
    SELECT t, i, left(t, i) AS a, substr(t, i + 1) AS b
    FROM (SELECT t, unnest(range(2, length(t) - 1)) AS i, (SELECT max(length(word)) FROM listed) AS longest FROM need WHERE length(t) >= 4)
    WHERE i <= longest AND length(t) - i <= longest),
  pairs AS MATERIALIZED (
    SELECT t, arg_min(greatest(x.lv, y.lv), i) AS lv FROM splits JOIN listed x ON x.word = a JOIN listed y ON y.word = b GROUP BY 1),
  shapes AS (
    SELECT t, length(t) AS n, t[1] AS first, right(t, 1) AS last, regexp_extract(t, '^{_R.ordinal}[{_R.numerals}]+') AS ordinal,
           regexp_extract(t, '^[{_R.numerals}]+') AS number, length(t) = 2 AND t[1] = t[2] AS is_double,
           length(t) = 4 AND t[1] = t[2] AND t[3] = t[4] AS is_aabb,
           length(t) = 2 AND contains('{_R.name_risk}', t[1]) AND contains('{_R.surnames}', t[2]) AS is_name FROM need),
  facts AS MATERIALIZED (
    SELECT s.*, own.lv AS own, twice.lv AS twice, m[first] AS first_lv, m[last] AS last_lv, base.lv AS base, pairs.lv AS pair,
           coalesce(run.lv, {_HIGHEST.format("[m[c] FOR c IN string_split(ordinal, '')]")}) AS ordinal_lv,
           {_HIGHEST.format("[m[c] FOR c IN string_split(number, '')]")} AS number_lv,
           substr(s.t, length(ordinal) + 1) AS after_ordinal, substr(s.t, length(number) + 1) AS after_number, substr(s.t, 2) AS after_first,
           left(s.t, n - 1) AS before_last
    FROM shapes s CROSS JOIN letters LEFT JOIN listed own ON own.word = s.t
      LEFT JOIN listed twice ON twice.word = CASE WHEN n = 1 THEN s.t || s.t END
      LEFT JOIN listed run ON run.word = CASE WHEN ordinal <> '' THEN ordinal END
      LEFT JOIN listed base ON base.word = CASE WHEN is_aabb THEN s.t[1] || s.t[3] END LEFT JOIN pairs ON pairs.t = s.t),
  levels (t, n, lv) USING KEY (t) AS (
    SELECT '', 0::BIGINT, NULL::INTEGER
    UNION
    (WITH step AS (SELECT max(n) + 1 AS n FROM levels),
     known AS (SELECT t, lv FROM recurring.levels)
     SELECT '', step.n, NULL FROM step WHERE step.n <= (SELECT max(n) FROM facts)
     UNION ALL
     SELECT f.t, f.n, coalesce(own, CASE WHEN f.n = 1 THEN twice ELSE coalesce(
         CASE WHEN ordinal = f.t THEN ordinal_lv WHEN ordinal <> '' THEN {_BOTH.format("ordinal_lv", "k1.lv")} END,
         CASE WHEN is_double THEN first_lv END, base,
         CASE WHEN last = '{_R.silent_suffix}' THEN k4.lv END,
         CASE WHEN number = f.t THEN number_lv WHEN number <> '' THEN {_BOTH.format("number_lv", "k2.lv")} END,
         CASE WHEN contains('{_R.prefixes}', first) AND NOT is_name THEN {_BOTH.format("first_lv", "k3.lv")} END,
         CASE WHEN contains('{_R.suffixes}', last) THEN {_BOTH.format("k4.lv", "last_lv")} END, pair) END)
     FROM facts f JOIN step USING (n) LEFT JOIN known k1 ON k1.t = after_ordinal LEFT JOIN known k2 ON k2.t = after_number
       LEFT JOIN known k3 ON k3.t = after_first LEFT JOIN known k4 ON k4.t = before_last))
  SELECT f.t AS word, l.lv AS decomposed_level,
    CASE WHEN f.n = 1 THEN 'single_char_via_doubled_form' WHEN ordinal <> '' THEN 'ordinal'
         WHEN is_double AND first_lv IS NOT NULL THEN 'reduplication' WHEN base IS NOT NULL THEN 'aabb_reduplication'
         WHEN last = '{_R.silent_suffix}' AND k4.lv IS NOT NULL THEN 'erhua_suffix'
         WHEN number = f.t THEN 'pure_numeral' WHEN number <> '' AND k2.lv IS NOT NULL THEN 'numeral_plus_unit'
         WHEN contains('{_R.prefixes}', first) AND NOT is_name AND k3.lv IS NOT NULL THEN
           CASE WHEN contains('{_R.verbs}', first) THEN 'verb_prefix' WHEN contains('{_R.pronouns}', first) THEN 'pronoun_prefix'
                WHEN contains('{_R.measures}', first) THEN 'measure_word' ELSE 'function_prefix' END
         WHEN contains('{_R.suffixes}', last) AND k4.lv IS NOT NULL THEN 'aspect_suffix' ELSE 'two_word_compound' END AS match_pattern
  FROM facts f JOIN vocab ON vocab.word = f.t JOIN levels l ON l.t = f.t LEFT JOIN levels k2 ON k2.t = after_number
    LEFT JOIN levels k3 ON k3.t = after_first LEFT JOIN levels k4 ON k4.t = before_last
  WHERE own IS NULL AND l.lv IS NOT NULL"""


@query("affixed_compound_levels", _AFFIXED)
def _(spark, sf):
    return resolve_words(I.vocabulary(spark, sf), I.wordlist(spark, sf), LATIN_RULES)


@query("labelled_counts", sql("lab", """
    SELECT word, exam_id, source_type, exam_level, frequency, word_level, match_pattern, effective_level, match_type
    FROM lab"""))
def _(spark, sf):
    return I.labelled(spark, sf)


@query("match_share", sql("lab", """
    SELECT *, matched_rows / total_rows AS row_share, matched_occurrences / total_occurrences AS occurrence_share
    FROM (SELECT count(*) FILTER (word_level IS NOT NULL) AS matched_rows, count(*) AS total_rows,
                 CAST(sum(frequency) FILTER (word_level IS NOT NULL) AS BIGINT) AS matched_occurrences,
                 CAST(sum(frequency) AS BIGINT) AS total_occurrences FROM lab)"""))
def _(spark, sf):
    from lexfreq.operators.counts import label_counts
    return V.match_share(label_counts(I.counts(spark, sf), I.wordlist(spark, sf).select("word", "word_level")))


@query("coverage_by_match_type", sql("lab", """
    SELECT *, words / sum(words) OVER () AS word_share, occurrences / sum(occurrences) OVER () AS occurrence_share
    FROM (SELECT match_type, count(DISTINCT word) AS words, CAST(sum(frequency) AS BIGINT) AS occurrences
          FROM lab GROUP BY 1)"""))
def _(spark, sf):
    return V.by_match_type(I.labelled(spark, sf))


_LEVEL_LABEL = "coalesce('L' || effective_level, 'Not in wordlist')"


@query("coverage_by_level", sql("lab", f"""
    SELECT {_LEVEL_LABEL} AS level_label, count(DISTINCT word) AS words, CAST(sum(frequency) AS BIGINT) AS occurrences
    FROM lab GROUP BY 1"""))
def _(spark, sf):
    return V.by_level(I.labelled(spark, sf))


@query("coverage_by_exam_level", sql("lab", """
    SELECT exam_level, count(DISTINCT word) FILTER (effective_level IS NOT NULL) AS words_matched,
           count(DISTINCT word) FILTER (effective_level IS NULL) AS words_unmatched,
           CAST(sum(frequency) FILTER (effective_level IS NOT NULL) AS BIGINT) AS occurrences_matched,
           CAST(sum(frequency) FILTER (effective_level IS NULL) AS BIGINT) AS occurrences_unmatched
    FROM lab GROUP BY 1"""))
def _(spark, sf):
    return V.by_exam_level(I.labelled(spark, sf))


_CROSS = """
    SELECT {label} AS level_label, coalesce({m3}, 0) AS exam_level_3, coalesce({m4}, 0) AS exam_level_4, coalesce({mx}, 0) AS exam_level_other
    FROM lab GROUP BY 1"""


@query("level_by_exam_level_occurrences", sql("lab", _CROSS.format(
    label=_LEVEL_LABEL, m3="CAST(sum(frequency) FILTER (exam_level = 3) AS BIGINT)",
    m4="CAST(sum(frequency) FILTER (exam_level = 4) AS BIGINT)",
    mx="CAST(sum(frequency) FILTER (exam_level NOT IN (3, 4) OR exam_level IS NULL) AS BIGINT)")))
def _(spark, sf):
    return V.level_by_exam_level(I.labelled(spark, sf), I.EXAM_LEVELS)


@query("level_by_exam_level_words", sql("lab", _CROSS.format(
    label=_LEVEL_LABEL, m3="count(DISTINCT word) FILTER (exam_level = 3)",
    m4="count(DISTINCT word) FILTER (exam_level = 4)",
    mx="count(DISTINCT word) FILTER (exam_level NOT IN (3, 4) OR exam_level IS NULL)")))
def _(spark, sf):
    return V.level_by_exam_level(I.labelled(spark, sf), I.EXAM_LEVELS, measure="words")


@query("decomposed_examples", sql("lab", """
    SELECT word, effective_level, match_pattern, CAST(sum(frequency) AS BIGINT) AS total_count FROM lab
    WHERE match_type = 'decomposed' GROUP BY 1, 2, 3 ORDER BY total_count DESC, word LIMIT 20"""))
def _(spark, sf):
    return V.decomposed_examples(I.labelled(spark, sf))


@query("pattern_counts", sql("lab", """
    SELECT match_pattern, count(DISTINCT word) AS words, CAST(sum(frequency) AS BIGINT) AS occurrences FROM lab
    WHERE match_type = 'decomposed' GROUP BY 1"""))
def _(spark, sf):
    return V.pattern_counts(I.labelled(spark, sf))


@query("top_unmatched", sql("lab", """
    SELECT word, CAST(sum(frequency) AS BIGINT) AS total_count FROM lab WHERE match_type = 'unmatched'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""))
def _(spark, sf):
    return V.top_unmatched(I.labelled(spark, sf), 30)


@query("coverage_funnel", sql("lab", """
    SELECT stage, name, occurrences, occurrences / whole AS share FROM (
      SELECT 1 AS stage, 'direct' AS name, CAST(sum(frequency) FILTER (match_type = 'direct') AS BIGINT) AS occurrences, sum(frequency) AS whole FROM lab
      UNION ALL
      SELECT 2, 'direct and decomposed', CAST(sum(frequency) FILTER (match_type <> 'unmatched') AS BIGINT), sum(frequency) FROM lab)"""))
def _(spark, sf):
    return V.funnel(I.labelled(spark, sf))


_REVIEW = "SELECT * FROM review"


@query("unmatched_review", sql("review", _REVIEW))
def _(spark, sf):
    return I.review(spark, sf)


@query("dictionary_confirmed", sql("review", _REVIEW + " WHERE in_dictionary"))
def _(spark, sf):
    return V.dictionary_confirmed(I.review(spark, sf))


@query("strongest_candidates", sql("review", """
    SELECT * REPLACE (true AS all_chars_known) FROM review
    WHERE char_length = 5 AND in_segmenter_dict AND in_dictionary AND NOT likely_noise
      AND NOT regexp_matches(word, '[^aehinorst]')"""))
def _(spark, sf):
    # A list of single letters stands for the characters a learner knows.
    words = I.review(spark, sf).drop("all_chars_known")
    letters = spark.createDataFrame([(c, 1) for c in "aehinorst"], "word string, word_level int")
    review = L.characters_known(words, letters).select(I.REVIEW)
    return V.strongest_candidates(review, length=5)


@query("triple_signal_noise", sql("review", _REVIEW + " WHERE likely_noise AND NOT in_segmenter_dict AND NOT in_dictionary"))
def _(spark, sf):
    return V.triple_signal_noise(I.review(spark, sf))


@query("noise_sample", sql("review", _REVIEW + """
    WHERE likely_noise AND NOT in_segmenter_dict AND NOT in_dictionary ORDER BY md5('42' || word), word LIMIT 15"""))
def _(spark, sf):
    return V.repeatable_sample(V.triple_signal_noise(I.review(spark, sf)))


@query("rescued_words", sql("review", _REVIEW + " WHERE likely_noise AND NOT in_segmenter_dict AND in_dictionary"))
def _(spark, sf):
    return V.rescued_words(I.review(spark, sf))


@query("review_flags", sql("review", """
    SELECT count(*) AS words, count(*) FILTER (likely_noise) AS likely_noise,
           count(*) FILTER (in_segmenter_dict) AS in_segmenter_dict, count(*) FILTER (in_dictionary) AS in_dictionary
    FROM review"""))
def _(spark, sf):
    return V.review_flags(I.review(spark, sf))


@query("heuristic_quality", sql("review", """
    SELECT *, 2 * precision * recall / (precision + recall) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (
      SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (
        SELECT heuristic, count(*) FILTER (guess AND truth) AS tp, count(*) FILTER (guess AND NOT truth) AS fp,
               count(*) FILTER (NOT guess AND truth) AS fn, count(*) FILTER (NOT guess AND NOT truth) AS tn
        FROM (SELECT 'not likely_noise' AS heuristic, NOT likely_noise AS guess, in_dictionary AS truth FROM review
              UNION ALL SELECT 'in_segmenter_dict', in_segmenter_dict, in_dictionary FROM review) GROUP BY 1))"""))
def _(spark, sf):
    return V.heuristic_quality(I.review(spark, sf))


@query("character_knowledge", sql("review vocab", "SELECT word, all_chars_known FROM known"))
def _(spark, sf):
    return L.characters_known(I.vocabulary(spark, sf), I.wordlist(spark, sf))


# --- rankings --------------------------------------------------------------------------------

_PER = """
    SELECT {column}, word, CAST(sum(frequency) AS BIGINT) AS total_count,
           CAST(row_number() OVER (PARTITION BY {column} ORDER BY sum(frequency) DESC, word) AS INTEGER) AS word_rank
    FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}, word QUALIFY word_rank <= 10"""


@query("top_overall", sql("counts", """
    SELECT word, CAST(sum(frequency) AS BIGINT) AS total_count FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(spark, sf):
    return A.top_overall(I.counts(spark, sf))


@query("top_per_level", sql("lab", _PER.format(column="effective_level", table="lab")))
def _(spark, sf):
    return A.top_per(I.labelled(spark, sf), "effective_level")


@query("top_per_source", sql("counts", _PER.format(column="source_type", table="counts")))
def _(spark, sf):
    return A.top_per(I.counts(spark, sf), "source_type")


@query("top_per_exam_level", sql("counts", _PER.format(column="exam_level", table="counts")))
def _(spark, sf):
    return A.top_per(I.counts(spark, sf), "exam_level")


@query("top_word_per_file", sql("counts", """
    SELECT exam_id, source_type, exam_level, word AS top_word, frequency AS top_word_count FROM counts
    QUALIFY row_number() OVER (PARTITION BY exam_id, source_type ORDER BY frequency DESC, word) = 1"""))
def _(spark, sf):
    return A.top_word_per_file(I.counts(spark, sf))


@query("top_summary", sql("lab", """
    SELECT word, CAST(sum(frequency) AS BIGINT) AS total_count, count(DISTINCT exam_id) AS exam_count,
           max(effective_level) AS effective_level, max(match_type) AS match_type
    FROM lab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""))
def _(spark, sf):
    return A.top_summary(I.labelled(spark, sf))


@query("rank_frequency", sql("counts", """
    SELECT word, total_count, row_number() OVER (ORDER BY total_count DESC, word) AS rank,
           max(total_count) OVER () / row_number() OVER (ORDER BY total_count DESC, word) AS ideal_count
    FROM (SELECT word, CAST(sum(frequency) AS BIGINT) AS total_count FROM counts GROUP BY 1)"""))
def _(spark, sf):
    return A.rank_frequency(I.counts(spark, sf))


_TOP15 = "(SELECT word FROM counts GROUP BY 1 ORDER BY sum(frequency) DESC, word LIMIT 15)"


@query("heat_map", sql("counts", f"""
    SELECT word, exam_id, CAST(sum(frequency) AS BIGINT) AS total_count FROM counts WHERE word IN {_TOP15} GROUP BY 1, 2"""))
def _(spark, sf):
    return A.heat_map(I.stored_counts(spark, sf))


# The columns this report asks for; what is in other exams is in the column `other`.
_EXAMS = [f"src{n}" for n in range(10)]


@query("heat_map_matrix", sql("counts", "SELECT word, " + ", ".join(
    f"CAST(coalesce(sum(frequency) FILTER (exam_id = '{e}'), 0) AS BIGINT) AS {e}" for e in _EXAMS)
    + f", CAST(coalesce(sum(frequency) FILTER (exam_id NOT IN {tuple(_EXAMS)}), 0) AS BIGINT) AS other FROM counts WHERE word IN {_TOP15} GROUP BY 1"))
def _(spark, sf):
    return A.heat_map_matrix(I.stored_counts(spark, sf), _EXAMS)


@query("list_size_against_seen", sql("lab", """
    SELECT word_level, coalesce(listed_words, 0) AS listed_words, coalesce(seen_words, 0) AS seen_words
    FROM (SELECT word_level, count(*) AS listed_words FROM wl GROUP BY 1)
    FULL JOIN (SELECT effective_level AS word_level, count(DISTINCT word) AS seen_words FROM lab
               WHERE effective_level IS NOT NULL GROUP BY 1) USING (word_level)"""))
def _(spark, sf):
    return A.list_size_against_seen(I.wordlist(spark, sf), I.labelled(spark, sf))


@query("words_per_level", sql("wl", "SELECT word_level, count(*) AS words FROM wl GROUP BY 1"))
def _(spark, sf):
    return A.words_per_level(I.wordlist(spark, sf))


@query("missing_levels", sql("wl", """
    SELECT CAST(l AS INTEGER) AS word_level FROM range(1, 10) t(l) WHERE l NOT IN (SELECT word_level FROM wl)"""))
def _(spark, sf):
    return A.missing_levels(I.wordlist(spark, sf))


@query("distinct_words", sql("vocab", "SELECT word FROM vocab"))
def _(spark, sf):
    return I.vocabulary(spark, sf)
