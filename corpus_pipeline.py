"""A training corpus from the documents table, stage by stage.

Each stage gets the session, the documents that its predecessor kept and the folder of the tables. All but the
last return documents with the columns they got; the last returns the token sequences in training order. What becomes of a
row says nothing of other rows with the same doc_id or none: stages number their rows and decide by that number.

What a stage writes meanwhile is deleted when the next one begins, since its result is written then. The token shards go to the folder that
the session names in `spark.lexfreq.shards`, or else to scratch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfreq.llm import mixing, token_shards, toxicity
from lexfreq.llm.decontaminate import decontaminate
from lexfreq.llm.scratch import stage_folder, table, written
from lexfreq.llm.simhash import similar_documents
from lexfreq.session import drop_scratch, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


SHARDS = "spark.lexfreq.shards"


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents, each as one column `row`, and a number for each, written so that it stays the same."""
    return written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered_documents")


def _without(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbered documents but those with the given numbers, as they were."""
    return docs.join(written(numbers.distinct(), "rejected"), "number", "left_anti").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    plain = docs.select("doc_id", "text")
    language = toxicity.language_model(plain)
    model = toxicity.train(plain, table(spark, sf_dir, "labels"), language)
    # The other columns travel with the text, so no row has to be found again.
    others = [c for c in docs.columns if c != "text"]
    scored = toxicity.score(docs.select("text", F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(others))).alias("others")), language, model)
    kept = scored.filter("predicted = 0")
    return kept.select(*(kept["text"] if c == "text" else kept["others"][f"c{others.index(c)}"].alias(c) for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 0.8 of their five-word shingles in common stays: the one with the smallest doc_id.

    Candidates are operator 3's components of fingerprints, found by ball hashing, and texts with equal minima of hashes, which also finds
    pairs at 0.8 that are more than 3 bits apart; all are checked by their shingles.
    Null doc_ids come last; of rows with the same doc_id the first by number stays.
    """
    rows = _numbered(docs)
    order = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), "row.doc_id", "number")
    found = similar_documents(rows.select(order.alias("doc_id"), "row.text"))
    return _without(rows, found.filter("doc_id <> component_id").select("doc_id.number"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item, or a whole shorter item, go."""
    rows = _numbered(docs)
    found = decontaminate(rows.select(F.col("number").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("number")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards and returns the token sequences with their places in the training order; the ids are those of the records."""
    sequences = token_shards.ordered(docs)
    token_shards.write_shards(sequences, spark.conf.get(SHARDS, None) or scratch_path(spark, "shards"))
    return sequences


def _in_own_folder(name: str, stage: Stage, last: bool = False) -> tuple[str, Stage]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_folder(spark, name, last):
            return stage(spark, docs, sf_dir)
    return name, run_stage


STAGES: list[tuple[str, Stage]] = [
    _in_own_folder("toxicity", toxicity_stage),
    _in_own_folder("near_duplicates", near_duplicates_stage),
    _in_own_folder("decontamination", decontamination_stage),
    _in_own_folder("mixing", mixing_stage),
    _in_own_folder("token_shards", token_stage, last=True),
]

# Toxicity scores and minima of hashes have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"kept-{name}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
