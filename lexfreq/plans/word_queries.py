"""Top words, comparison, search, word detail, and the steps the word table does on a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions import arguments, reading
from lexfreq.functions.quality import all_true
from lexfreq.operators.counts import live_totals
from lexfreq.operators.keyed import global_rank, top_k_per_group
from lexfreq.operators.ngram_index import search
from lexfreq.operators.sentences import distance, with_first_file, word_sentence_pairs
from lexfreq.plans.corpus import Corpus
from lexfreq.session import stored

FILE_KEY = ["exam_id", "source_type"]


def list_exams(sources: DataFrame) -> DataFrame:
    """One row per exam: level, year and its source types."""
    return (sources.groupBy("exam_id")
            .agg(F.max("exam_level").alias("exam_level"), F.max("year").alias("year"),
                 F.array_sort(F.collect_set("source_type")).alias("source_types"))
            .orderBy(F.col("exam_level").asc_nulls_last(), "exam_id"))


def _with_ids(rows: DataFrame, exam_ids: Sequence[str]) -> DataFrame:
    ids = rows.sparkSession.createDataFrame([(i,) for i in exam_ids], "exam_id STRING").distinct()
    return rows.join(ids, "exam_id", "left_semi")


def _scoped(corpus: Corpus, word_level: int | None, exam_level: int | None,
            exam_ids: Sequence[str] | None, source_type: str) -> DataFrame:
    """Frequency rows in scope. Exam ids go before the paper level; other filters combine.

    Only sources in scope are joined, so the paper level prunes the small side first.
    """
    rows, sources = corpus.frequencies, corpus.sources
    conditions: list[Column] = []
    if source_type != "all":
        conditions.append(F.col("source_type") == source_type)
        sources = sources.filter(F.col("source_type") == source_type)
    if word_level is not None:
        conditions.append(F.col("word_level") == word_level)
    rows = rows.filter(all_true(conditions))
    if exam_ids:
        rows = _with_ids(rows, exam_ids)
    elif exam_level is not None:
        sources = sources.filter(F.col("exam_level") == exam_level)
    return rows.join(sources.select(*FILE_KEY), FILE_KEY)


def _rollup_scope(corpus: Corpus, word_level: int | None, source_type: str) -> DataFrame:
    conditions = [F.col("source_type") == source_type]
    if word_level is not None:
        conditions.append(F.col("word_level") == word_level)
    return corpus.aggregates.filter(all_true(conditions))


def _check(word_level, exam_level, source_type, source_types) -> None:
    arguments.level(word_level, "word_level")
    arguments.level(exam_level, "exam_level")
    arguments.source_type(source_type, source_types)


def top_words(corpus: Corpus, word_level: int | None = None, exam_level: int | None = None,
              exam_ids: Sequence[str] | None = None, source_type: str = "all", limit: int = 50,
              source_types=V.SOURCE_TYPES) -> DataFrame:
    """The most frequent words in scope. Without an exam scope the rollup answers."""
    _check(word_level, exam_level, source_type, source_types)
    arguments.limit(limit, V.TOP_LIMIT)
    columns = ["word", "word_level", "effective_level", "source_type", "total_frequency", "exam_count",
               "in_official_wordlist", "pinyin"]
    readings = corpus.wordlist.groupBy("word").agg(F.max("pinyin").alias("pinyin"))
    totals = scope_words(corpus, word_level, exam_level, exam_ids, source_type)
    # The limit comes before the join: a reading is looked up for the listed words only.
    first = totals.orderBy(F.desc("total_frequency"), "word").limit(limit)
    return first.join(readings, "word", "left").select(*columns).orderBy(F.desc("total_frequency"), "word")


def scope_words(corpus: Corpus, word_level: int | None = None, exam_level: int | None = None,
                exam_ids: Sequence[str] | None = None, source_type: str = "all") -> DataFrame:
    """Every word in scope with its totals."""
    if not exam_ids and exam_level is None:
        return _rollup_scope(corpus, word_level, source_type)
    types = F.when(F.min("source_type") != F.max("source_type"), F.lit("all")).otherwise(F.min("source_type"))
    return live_totals(_scoped(corpus, word_level, exam_level, exam_ids, source_type),
                       types.alias("source_type"),
                       F.bool_or("in_official_wordlist").alias("in_official_wordlist"))


def top_words_total(corpus: Corpus, word_level: int | None = None, exam_level: int | None = None,
                    exam_ids: Sequence[str] | None = None, source_type: str = "all",
                    source_types=V.SOURCE_TYPES) -> DataFrame:
    """How many words the scope holds, whatever the limit of the list."""
    _check(word_level, exam_level, source_type, source_types)
    if not exam_ids and exam_level is None:
        return _rollup_scope(corpus, word_level, source_type).agg(F.count("*").alias("total_count"))
    rows = _scoped(corpus, word_level, exam_level, exam_ids, source_type)
    return rows.agg(F.count_distinct("word").alias("total_count"))


def compare_words(corpus: Corpus, word_level: int | None = None, exam_level: int | None = None,
                  exam_id: str | None = None, source_type: str = "all", limit: int = 50,
                  source_types=V.SOURCE_TYPES) -> DataFrame:
    """Both ranked lists, told apart by `side`: listed words and words not in the word list.

    One pass over the scope; the limit per side is applied before the shuffle.
    """
    _check(word_level, exam_level, source_type, source_types)
    arguments.limit(limit, V.COMPARE_LIMIT)
    official = F.col("in_official_wordlist")
    if exam_id is None and exam_level is None:
        totals = _rollup_scope(corpus, word_level, source_type)
    else:
        rows = _scoped(corpus, word_level, exam_level, [exam_id] if exam_id is not None else None, source_type)
        totals = rows.groupBy("word", "word_level", "in_official_wordlist").agg(
            F.sum("frequency").alias("total_frequency"), F.count_distinct("exam_id").alias("exam_count"))
    readings = (corpus.wordlist.groupBy("word").agg(F.min("pinyin").alias("pinyin"))
                .withColumn("__listed", F.lit(True)))
    # A listed word must be in the word list itself, which the join decides before the ranking.
    sided = (totals.filter(official.isNotNull()).join(readings, "word", "left")
             .filter(~official | F.col("__listed"))
             .withColumn("side", F.when(official, "in_official_wordlist").otherwise("not_in_official_wordlist"))
             .withColumn("pinyin", F.when(official, F.col("pinyin"))))
    ranked = top_k_per_group(sided, ["side"], [F.desc("total_frequency"), F.asc("word")], limit, rank="side_rank")
    return ranked.select("side", "side_rank", "word", "word_level", "total_frequency", "exam_count", "pinyin")


def word_occurrences(corpus: Corpus, query: str) -> DataFrame:
    """Frequency of one word in every file."""
    arguments.query(query)
    sources = corpus.sources.select(*FILE_KEY, "year", "filename")
    return (corpus.frequencies.filter(F.col("word") == query)
            .join(sources, FILE_KEY, "left")
            .select("word", "word_level", "source_type", "exam_id", "frequency", "in_official_wordlist",
                    "year", "filename")
            .orderBy(F.desc("frequency"), "exam_id", "source_type"))


def word_aggregates(corpus: Corpus, query: str) -> DataFrame:
    arguments.query(query)
    return corpus.aggregates.filter(F.col("word") == query).orderBy("source_type")


def sentences_with(corpus: Corpus, query: str) -> DataFrame:
    """Sentences that hold the query as it is written; no character is a wildcard. A stored corpus looks them up in its index."""
    arguments.query(query)
    if corpus.index is not None:
        return search(corpus.sentences.sparkSession, corpus.index, query)
    return corpus.sentences.filter(F.contains(F.col("sentence"), F.lit(query)))


def sentence_totals(sentences: DataFrame) -> DataFrame:
    return sentences.agg(
        F.count_distinct("sentence").alias("sentence_total"),
        F.count_distinct(F.struct(*FILE_KEY)).alias("file_total"))


def example_sentences(corpus: Corpus, query: str, limit: int = V.MAX_EXAMPLES) -> DataFrame:
    """Examples spread over files: one file per sentence, one sentence per file, best length first."""
    first_file = sentences_with(corpus, query).groupBy("sentence").agg(
        F.min(F.struct(*FILE_KEY)).alias("file"))
    best = (first_file.groupBy("file")
            .agg(F.min(F.struct(distance(F.col("sentence")).alias("distance"), "sentence")).alias("pick"))
            .select("file.*", "pick.*"))
    sources = corpus.sources.select(*FILE_KEY, "filename", "exam_level")
    return (best.join(sources, FILE_KEY)
            .orderBy("distance", "sentence").limit(limit)
            .select("sentence", *FILE_KEY, "filename", "exam_level"))


def word_detail(corpus: Corpus, query: str) -> DataFrame:
    """One row: word list entry (nulls when unlisted) and sentence totals."""
    totals = sentence_totals(sentences_with(corpus, query)).withColumn("word", F.lit(query))
    info = (corpus.wordlist.filter(F.col("word") == query)
            .select("word", "pinyin", "word_level", "definition", "definition_th", F.lit(True).alias("__listed")))
    return (totals.join(info, "word", "left")
            .select("word", F.coalesce("__listed", F.lit(False)).alias("in_wordlist"), "pinyin", "word_level",
                    "definition", "definition_th", "sentence_total", "file_total"))


def sentence_totals_of_all_words(corpus: Corpus) -> DataFrame:
    """sentence_total and file_total of every word in the word list that occurs in a sentence.

    A sentence counts where it is marked first, a file once per word: both are plain sums.
    """
    pairs = word_sentence_pairs(with_first_file(corpus.sentences), corpus.wordlist.select("word").distinct(),
                                [*FILE_KEY, "is_first"])
    per_file = pairs.groupBy("word", *FILE_KEY).agg(F.count_if("is_first").alias("first_here"))
    return per_file.groupBy("word").agg(
        F.sum("first_here").alias("sentence_total"), F.count("*").alias("file_total"))


def examples_of_all_words(corpus: Corpus, limit: int = V.MAX_EXAMPLES) -> DataFrame:
    """Example sentences of every listed word: example_sentences() for the whole list at once.

    Neither which file stands for a sentence nor which of two sentences is the better example depends on
    the word: both are settled first, and sentences go through the join as their place in that order. Their texts
    are fetched for the examples alone.
    """
    sentences = with_first_file(corpus.sentences).filter("is_first").select(*FILE_KEY, "sentence")
    sentences = sentences.withColumn("distance", distance(F.col("sentence")))
    ordered = global_rank(sentences, [F.asc("distance"), F.asc("sentence")], "place")
    pairs = word_sentence_pairs(ordered, corpus.wordlist.select("word").distinct(), [*FILE_KEY, "place"])
    best = pairs.groupBy("word", *FILE_KEY).agg(F.min("place").alias("place"))
    known = best.join(corpus.sources.select(*FILE_KEY, "filename", "exam_level"), FILE_KEY)
    picked = top_k_per_group(known, ["word"], [F.asc("place")], limit, rank="example_rank")
    return picked.join(ordered.select("place", "distance", "sentence"), "place").select(
        "word", *FILE_KEY, "distance", "sentence", "filename", "exam_level", "example_rank")


def scope_summary(items: DataFrame) -> DataFrame:
    """Figures of a word list: occurrences, listed and unlisted words, widest spread."""
    return items.agg(
        F.sum("total_frequency").alias("total_occurrences"),
        F.count_if("in_official_wordlist").alias("official_words"),
        (F.count("*") - F.count_if("in_official_wordlist")).alias("unofficial_words"),
        F.max("exam_count").alias("max_exam_count"))


def levelled_words(items: DataFrame) -> DataFrame:
    return items.filter(F.col("word_level").isNotNull())


def search_words(items: DataFrame, query: str) -> DataFrame:
    """Words with a level whose spelling or plain reading holds the query."""
    plain = F.col("pinyin_plain") if "pinyin_plain" in items.columns else reading.plain_reading(F.col("pinyin"))
    return levelled_words(items).filter(reading.matches(F.col("word"), plain, query))


def ranked_items(items: DataFrame) -> DataFrame:
    """Items with their place by descending total. Written to the shared folder, so that pages can be taken from it."""
    return stored(global_rank(items, [F.desc("total_frequency"), F.asc("word")], "place"), "ranked_items")


def word_page(ranked: DataFrame, page: int, page_size: int = V.PAGE_SIZE) -> DataFrame:
    """Page k (from 1) of ranked items; a page behind the end is the last page. Only the page's rows leave the scan."""
    if page < 1:
        raise ValueError("pages start at 1")
    items = ranked.agg(F.coalesce(F.max("place"), F.lit(0))).scalar()
    last = F.greatest(F.lit(1), F.ceil(items / page_size))
    first = (F.least(F.lit(page), last) - 1) * page_size
    return (ranked.filter((F.col("place") > first) & (F.col("place") <= first + page_size))
            .orderBy("place").drop("place"))


def exam_groups(sources: DataFrame, query: str = "") -> DataFrame:
    """(exam_level, exam_id) of exams whose id holds the query, unlevelled exams last."""
    exams = sources.groupBy("exam_id").agg(F.max("exam_level").alias("exam_level"))
    asked = query.strip().lower()
    if asked:
        exams = exams.filter(F.contains(F.lower("exam_id"), F.lit(asked)))
    return exams.select("exam_level", "exam_id").orderBy(F.col("exam_level").asc_nulls_last(), "exam_id")


def exam_levels(sources: DataFrame) -> DataFrame:
    return sources.filter("exam_level IS NOT NULL").select("exam_level").distinct().orderBy("exam_level")


def unlisted_by_exams(corpus: Corpus, limit: int = 20) -> DataFrame:
    """Words outside the word list by the number of exams they occur in."""
    return (corpus.frequencies.filter(~F.col("in_official_wordlist"))
            .groupBy("word").agg(F.count_distinct("exam_id").alias("exam_count"))
            .orderBy(F.desc("exam_count"), "word").limit(limit))
