"""Operator 7, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Disguised words are restored first (see deobfuscate.py) with a character language model counted over all
documents. The score is a logistic regression on words and word beginnings of the restored text, present or
not. Labels are learnt from a bounded sample of the labelled rows that are not held out; neither labels
nor lang, source or doc_id are inputs of a score.

Features are hashed to 2^22 buckets. Of these the model keeps at most MOST_FEATURES, those whose presence
tells most about the label over the sample (G test); counts are aggregated in Spark.

Defined cases: a null or empty text has no features and gets the score of the bias alone. Labels that are
null or other than 0 and 1 are not learnt from; without any usable label all scores are those of a model
without features. Rows with equal or null doc_ids each get their own row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfreq.llm import linear
from lexfreq.llm.deobfuscate import LETTERS, Restorer, language_model
from lexfreq.llm.scratch import arrow_map, written
from lexfreq.llm.words import Words, find_words, slices

SAMPLE_ROWS = 16_384
BUCKET_BITS = 22
BEGINNINGS = (3, 4, 5, 6, 7)
MOST_FEATURES = 8_192
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def _buckets(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and buckets: whole words, then beginnings of longer words."""
    shift = np.uint64(64 - BUCKET_BITS)
    yield words.text, (words.hashes() >> shift).astype(np.int64)
    for length in BEGINNINGS:
        longer = words.end - words.begin > length
        hashes = words.hashes(0, length) * np.uint64(2 * length + 1)
        yield words.text[longer], (hashes[longer] >> shift).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, fold: int) -> DataFrame:
    """doc_id, text and label of at most `rows` documents, chosen by a hash of the doc_id."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` bounds the side that is broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def _presence(sample: DataFrame, model: bytes) -> DataFrame:
    """doc_id, label and the sorted distinct buckets of each sampled document."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for part in slices(batches):
            words = find_words(restorer.restore(part["text"])[0], LETTERS)
            pairs = np.unique(np.concatenate([(t << BUCKET_BITS) | b for t, b in _buckets(words)]))
            counts = np.bincount(pairs >> BUCKET_BITS, minlength=part.num_rows)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            buckets = pa.array((pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["label"], pa.ListArray.from_arrays(pa.array(offsets), buckets)], ["doc_id", "label", "buckets"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    return arrow_map(sample.select("doc_id", "label", "text"), run, f"doc_id {kind}, label int, buckets array<int>")


def _telling(present: DataFrame, most: int) -> list[int]:
    """The buckets whose presence tells most about the label."""
    n, positive = present.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    seen = (present.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket")
            .agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("c")).filter("c >= 3"))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    a, c = F.col("a"), F.col("c")
    share = positive / max(n, 1)
    g = 2 * (part(a, c * share) + part(c - a, c * (1 - share)) + part(positive - a, (n - c) * share)
             + part((n - c) - (positive - a), (n - c) * (1 - share)))
    rows = seen.withColumn("g", g).filter("g > 10").orderBy(F.desc("g"), "bucket").limit(most)
    return [r.bucket for r in rows.select("bucket").collect()]


def train(docs: DataFrame, labels: DataFrame, language: bytes, sample_rows: int = SAMPLE_ROWS,
          most_features: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets (sorted), their weights, and the bias."""
    sample = labelled_sample(docs, labels, "toxic", sample_rows, FOLDS, HELD_OUT)
    present = written(_presence(sample, language), "toxicity_features")
    buckets = np.array(sorted(_telling(present, most_features)), np.int64)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["buckets"]
            flat = lists.flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(buckets, flat)
            known = (place < len(buckets)) & (buckets[np.minimum(place, len(buckets) - 1)] == flat) if len(buckets) else np.zeros(len(flat), bool)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[known], minlength=len(lists)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[known].astype(np.int32)))],
                ["doc_id", "label", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(present, only, f"doc_id {kind}, label int, features array<int>").toPandas().sort_values("doc_id", kind="stable")
    label = rows["label"].to_numpy()
    lift = (label == 0).sum() / label.sum() if 0 < label.sum() < len(label) else 1.0
    weights, bias = linear.fit_at([np.asarray(f, np.int64) for f in rows["features"]], label, len(buckets), THRESHOLD, lift=lift)
    return buckets, weights, bias


def score(docs: DataFrame, language: bytes, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """All columns of the documents, and score, predicted and n_restored (disguised words restored); columns of these names are replaced."""
    docs = docs.drop("score", "predicted", "n_restored")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((language, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (buckets, weights, bias) = shared.value
        restorer = Restorer(table)
        known = np.zeros(1 << BUCKET_BITS, np.int32)
        known[buckets] = np.arange(1, len(buckets) + 1)
        for part in slices(batches):
            restored, changed = restorer.restore(part["text"])
            words = find_words(restored, LETTERS)
            hits = []
            for text, bucket in _buckets(words):
                number = known[bucket]
                there = number > 0
                hits.append((text[there] << BUCKET_BITS) | (number[there] - 1))
            pairs = np.unique(np.concatenate(hits))
            total = np.bincount(pairs >> BUCKET_BITS, weights[pairs & ((1 << BUCKET_BITS) - 1)] if len(buckets) else None,
                                minlength=part.num_rows) + bias
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in part.schema.names), pa.array(linear.sigmoid(total)), pa.array(changed)],
                [*part.schema.names, "score", "n_restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, score double, n_restored bigint").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_restored of every document."""
    plain = docs.select("doc_id", "text")
    language = language_model(plain)
    model = train(plain, labels.select("doc_id", "toxic"), language, sample_rows)
    return score(plain, language, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_restored")
