"""Operator 5, quality by a factorisation machine.

Inputs of a score are the hashed words of a text, statistics of its structure, and its metadata (the
recorded number of characters). Every input i has a weight w_i and a vector v_i of RANK numbers; the score is
the logistic function of

    w_0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which takes time in proportion to the inputs, though it weighs all pairs of them. Words have the value
count / root of the sum of squared counts; statistics are standardised and cut at four deviations.

The machine is fitted with AdaGrad on a bounded sample of labelled rows that are not held out. Neither
labels nor lang, source or doc_id are inputs.

Defined cases: a null or empty text has no words, its statistics are those of nothing, and it gets a score. A null
n_chars, or a table without that column, counts as the length of the text. Labels that are null or other than 0 and 1 are not
learnt from; without usable labels the score is 0.5 for all. Rows with equal or null doc_ids each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.linear import sigmoid
from lexfreq.llm.scratch import arrow_map, written
from lexfreq.llm.toxicity import held_out
from lexfreq.llm.words import SPACED, find_words, flat, slices

SAMPLE_ROWS = 8_192
BUCKET_BITS = 16
RANK = 8
EPOCHS = 8
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def _kind(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_KINDS = {
    "upper": _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _kind("0123456789"), "stop": _kind(".,;:"), "bang": _kind("!?"),
    "symbol": _kind("#$%&*@^~=+<>_{}[]\\/"), "bar": _kind("|"), "quote": _kind("\"'()-"), "line": _kind("\n"), "space": _kind(" \t\r\x0b\x0c"),
    "wide": np.arange(256) >= 0x80,
}
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False
STATISTICS = [*(f"share_{k}" for k in _KINDS), "log_bytes", "log_words", "mean_word", "odd_ends", "capital_words",
              "distinct_words", "words_per_line", "distinct_lines", "log_lines", "log_recorded", "recorded_against_bytes"]


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(t[new], minlength=n)


def _structure(column: pa.Array, recorded: np.ndarray, words) -> np.ndarray:
    """One row of STATISTICS for each text."""
    raw, starts = flat(column)
    n = len(starts) - 1
    size = np.diff(starts).astype(float)
    shares = [_per_text(kind[raw], starts) / np.maximum(size, 1) for kind in _KINDS.values()]
    count = words.counts().astype(float)
    some = np.maximum(count, 1)
    last, first = raw[words.end - 1], raw[words.begin]
    odd = np.bincount(words.text[_KINDS["symbol"][last] | _KINDS["bang"][last] | _KINDS["bar"][last]], minlength=n)
    capital = np.bincount(words.text[_KINDS["upper"][first]], minlength=n)
    lines = find_words(column, _IN_LINE)
    n_lines = lines.counts().astype(float)
    return np.stack([
        *shares, np.log1p(size), np.log1p(count), np.bincount(words.text, words.end - words.begin, minlength=n) / some,
        odd / some, capital / some, _distinct(words.text, words.hashes(), n) / some, count / np.maximum(n_lines, 1),
        _distinct(lines.text, lines.hashes(), n) / np.maximum(n_lines, 1), np.log1p(n_lines), np.log1p(np.maximum(recorded, 0)),
        np.log1p(np.maximum(recorded, 0)) - np.log1p(size)], axis=1)


@dataclass
class Inputs:
    """Word inputs of several texts as a sparse matrix by row, and their statistics."""

    owner: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


def inputs(part: pa.RecordBatch) -> Inputs:
    column = part["text"]
    words = find_words(column, SPACED)
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(float)
    recorded = part["n_chars"].to_numpy(zero_copy_only=False).astype(float)
    statistics = _structure(column, np.where(np.isnan(recorded), lengths, recorded), words)
    keys = (words.text << BUCKET_BITS) | (words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    owner = keys >> BUCKET_BITS
    squares = np.bincount(owner, counts.astype(float)**2, minlength=part.num_rows)
    return Inputs(owner, keys & ((1 << BUCKET_BITS) - 1), counts / np.sqrt(squares[owner]), statistics)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.spread, -4, 4)

    def score(self, x: Inputs) -> np.ndarray:
        return sigmoid(self._raw(x.owner, x.bucket, x.value, self.standard(x.statistics))[0])

    def _raw(self, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, words = len(z), 1 << BUCKET_BITS
        total = self.bias + np.bincount(owner, self.w[bucket] * value, minlength=n) + z @ self.w[words:]
        sums = np.empty((n, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            own = self.v[bucket, f] * value
            fixed = self.v[words:, f]
            sums[:, f] = np.bincount(owner, own, minlength=n) + z @ fixed
            total += 0.5 * (sums[:, f]**2 - np.bincount(owner, own * own, minlength=n) - (z * z) @ (fixed * fixed))
        return total, sums


def fit(x: Inputs, labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.05,
        penalty: float = 1e-5, seed: int = 1) -> Machine:
    words, n_statistics = 1 << BUCKET_BITS, x.statistics.shape[1]
    random = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(words + n_statistics), random.normal(0, 0.02, (words + n_statistics, rank)),
                      x.statistics.mean(axis=0) if len(labels) else np.zeros(n_statistics),
                      x.statistics.std(axis=0) + 1e-6 if len(labels) else np.ones(n_statistics))
    if not len(labels):
        machine.v[:] = 0
        return machine
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine.bias = float(np.log(share / (1 - share)))
    z_all = machine.standard(x.statistics)
    firsts = np.searchsorted(x.owner, np.arange(len(labels) + 1))
    grown_w, grown_v, grown_b = np.full(machine.w.shape, 1e-2), np.full(machine.v.shape, 1e-2), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            picked = np.concatenate([np.arange(firsts[r], firsts[r + 1]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), firsts[rows + 1] - firsts[rows])
            bucket, value, z = x.bucket[picked], x.value[picked], z_all[rows]
            raw, sums = machine._raw(owner, bucket, value, z)
            error = (sigmoid(raw) - labels[rows]) / len(rows)
            used, place = np.unique(bucket, return_inverse=True)
            place_w = np.concatenate([used, words + np.arange(n_statistics)])
            pull = error[owner] * value
            g = np.concatenate([np.bincount(place, pull, minlength=len(used)), error @ z]) + penalty * machine.w[place_w]
            grown_w[place_w] += g * g
            squares = np.concatenate([np.bincount(place, pull * value, minlength=len(used)), error @ (z * z)])
            for f in range(rank):
                h = np.concatenate([np.bincount(place, pull * sums[owner, f], minlength=len(used)), (error * sums[:, f]) @ z])
                h += (penalty - squares) * machine.v[place_w, f]
                grown_v[place_w, f] += h * h
                machine.v[place_w, f] -= rate * h / np.sqrt(grown_v[place_w, f])
            machine.w[place_w] -= rate * g / np.sqrt(grown_w[place_w])
            grown_b += error.sum()**2
            machine.bias -= rate * error.sum() / np.sqrt(grown_b)
    return machine


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars, which may be missing."""
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", recorded.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """The machine fitted on at most `sample_rows` labelled rows."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(FOLDS, HELD_OUT))
    sample = (usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # `sample_rows` bounds the side that is broadcast.
    texts = _plain(docs).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = inputs(part)
            offsets = pa.array(np.searchsorted(x.owner, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["label"], pa.ListArray.from_arrays(offsets, pa.array(x.bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(x.value.astype(np.float32))), pa.array(list(x.statistics))],
                ["doc_id", "label", "bucket", "value", "statistics"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label int, bucket array<int>, value array<float>, statistics array<double>"
    rows = written(arrow_map(texts.select("doc_id", "text", "n_chars", "label"), run, schema), "quality_inputs")
    found = rows.toPandas().sort_values("doc_id", kind="stable")
    lengths = [len(b) for b in found["bucket"]]
    x = Inputs(np.repeat(np.arange(len(found)), lengths),
               np.concatenate([np.zeros(0, np.int64), *found["bucket"]]).astype(np.int64),
               np.concatenate([np.zeros(0), *found["value"]]).astype(float),
               np.stack(list(found["statistics"])) if len(found) else np.zeros((0, len(STATISTICS))))
    return fit(x, found["label"].to_numpy(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(shared.value.score(inputs(part)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(_plain(docs), run, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
