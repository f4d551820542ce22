"""The operators over the supplied tables with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfreq.llm import ann, html_text, line_dedup, mixing, pii, quality, ranked_search, simhash, spelling, substring_dedup, token_shards, toxicity
from lexfreq.llm.decontaminate import covered, decontaminate
from lexfreq.llm.scratch import table
from lexfreq.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "row.doc_id", "size", "source_size", "target", "taken")


def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), every=100)


def op3_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the shards and returns where each sequence stands, with a digest of its record."""
    sequences = token_shards.ordered(table(spark, folder, "documents"))
    token_shards.write_shards(sequences, scratch_path(spark, "shards"))
    step = token_shards.stride()
    return sequences.select("slot", "shard", (F.col("record").cast("bigint") * step).alias("byte_offset"),
                            F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.begin").alias("begins"), F.col("pieces.n").alias("counts"),
                            "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"),
                        F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace(table(spark, folder, "documents").select("doc_id", "text"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


OP9_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT rid, pos, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT rid, pos, n FROM m)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mix_sources, op2_nearest_vectors, op3_simhash_near_duplicates, op4_line_dedup, op5_quality, op6_token_shards, op7_toxicity,
    op8_main_text, op9_decontaminate, op10_surrogates, op11_substring_dedup, op12_ranked_search, op13_spelling_variants)}

ORACLES = {"op4_line_dedup": line_dedup.ORACLE, "op9_decontaminate": OP9_ORACLE, "op11_substring_dedup": substring_dedup.ORACLE,
           "op12_ranked_search": ranked_search.ORACLE}
