"""Operator 9, benchmark decontamination by winnowing.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters, lower-cased in A-Z.
A window is 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Document words inside any occurrence of a window are hit.

Winnowing: of every 10 words, the smallest of their six 5-word hashes is a fingerprint. Whatever
stands in both a document and an item over 10 words has the same smallest hash in both, so no
shared window is missed, and about two in seven positions are kept. Fingerprints of documents are
joined with those of the items through a bit table of fixed size, which holds all item
fingerprints; what passes is extended to the windows around it, and these are joined exactly (by
two 64-bit hashes) in a Spark join. Items shorter than a window cannot be winnowed; document spans
of their lengths go through the same bit table and the same join.

Defined cases: a null or empty text has no words, hits nothing and is returned with zeros. Repeated
rows and repeated or null doc_ids each give their own row. Items without words have no windows;
an item whose item_id is null marks words but is not counted or listed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, written
from lexfreq.llm.words import ALPHANUMERIC, Words, find_words, grams, mix, slices

WINDOW = 10
GRAM = 5
TABLE_BITS = 24

_SPAN = "struct<n:int,pos:int,h1:bigint,h2:bigint>"
_ARROW_SPAN = pa.struct([("n", pa.int32()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _fingerprints(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen grams, and all gram hashes."""
    values = grams(hashes, gram)
    starts = len(hashes) - window + 1
    if starts <= 0:
        return np.zeros(0, np.int64), values
    best, where = values[:starts].copy(), np.arange(starts)
    for shift in range(1, window - gram + 1):
        other = values[shift:shift + starts]
        better = other <= best
        best = np.where(better, other, best)
        where = np.where(better, np.arange(starts) + shift, where)
    whole = words.text[:starts] == words.text[window - 1:window - 1 + starts]
    return np.unique(where[whole]), values


def _spans(words: Words, n: int, at: np.ndarray, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """n, text number, position within the text and both hashes of the spans of n words from `at`."""
    first = words.firsts()[words.text[at]]
    return [np.full(len(at), n, np.int32), words.text[at], (at - first).astype(np.int32),
            *(h[at].view(np.int64) for h in hashes)]


def _slot(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bit of a fingerprint; n is 0 for winnowed ones, else the length of the short item."""
    return mix(values + np.uint64(n)) >> np.uint64(64 - bits)


def _listed(parts: list[list[np.ndarray]], n_texts: int) -> pa.Array:
    """Spans as one list per text."""
    n, text, pos, h1, h2 = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
    order = np.argsort(text, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text.astype(np.int64), minlength=n_texts))])
    values = pa.StructArray.from_arrays(
        [pa.array(x[order].astype(kind)) for x, kind in ((n, np.int32), (pos, np.int32), (h1, np.int64), (h2, np.int64))],
        fields=list(_ARROW_SPAN))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = TABLE_BITS) -> DataFrame:
    """One row per window of each item: item_id, n, h1, h2, and the table slot of its fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], ALPHANUMERIC)
            both = [words.hashes(0), words.digests()]
            counts = words.counts()
            for n in range(1, window + 1):
                if n < window:
                    at = words.firsts()[:-1][counts == n]
                else:
                    at = np.flatnonzero(words.text[:-n + 1] == words.text[n - 1:]) if n > 1 else np.arange(len(words.text))
                if not len(at):
                    continue
                hashes = [grams(both[0], n, 0), grams(both[1], n, 1)]
                spans = _spans(words, n, at, hashes)
                if n < window:
                    slots = _slot(hashes[0][at], n, bits)
                else:
                    values = grams(both[0], gram)
                    slots = _slot(np.min([values[at + i] for i in range(window - gram + 1)], axis=0), 0, bits)
                yield pa.RecordBatch.from_arrays(
                    [part["item_id"].take(pa.array(spans[1])), pa.array(spans[0]), pa.array(spans[3]), pa.array(spans[4]),
                     pa.array(slots.astype(np.int32))], ["item_id", "n", "h1", "h2", "slot"])

    kind = items.schema["item_id"].dataType.simpleString()
    return arrow_map(items.select("item_id", "text"), run, f"item_id {kind}, n int, h1 bigint, h2 bigint, slot int")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, n_words, spans (position and length of every hit span) and item_ids of each document."""
    windows = written(item_windows(items, window, gram, bits), "item_windows")
    # Both collected sets are bounded by the parameters: 2^bits slots, and window lengths.
    slots = windows.select("slot").distinct().toPandas()["slot"].to_numpy(np.int64)
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    filled = np.zeros(1 << bits, bool)
    filled[slots] = True
    bit_table = docs.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bit_table.value

        def there(values: np.ndarray, n: int) -> np.ndarray:
            slot = _slot(values, n, bits).astype(np.int64)
            return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

        for part in slices(batches):
            words = find_words(part["text"], ALPHANUMERIC)
            both = [words.hashes(0), words.digests()]
            found = []
            for n in lengths:
                if n < window:
                    if len(words.text) < n:
                        continue
                    at = np.flatnonzero(words.text[:len(words.text) - n + 1] == words.text[n - 1:])
                    at = at[there(grams(both[0], n, 0)[at], n)]
                else:
                    chosen, values = _fingerprints(words, both[0], window, gram)
                    chosen = chosen[there(values[chosen], 0)]
                    at = np.unique((chosen[:, None] - np.arange(window - gram + 1)).ravel())
                    at = at[(at >= 0) & (at + n <= len(words.text))]
                    at = at[words.text[at] == words.text[at + n - 1]]
                if len(at):
                    found.append(_spans(words, n, at, [grams(both[0], n, 0), grams(both[1], n, 1)]))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(words.counts().astype(np.int64)), _listed(found, words.n_texts)],
                ["doc_id", "n_words", "candidates"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, candidates array<{_SPAN}>")
    base = written(scanned.withColumn("row_id", F.monotonically_increasing_id()), "scanned_documents")
    exact = windows.groupBy("n", "h1", "h2").agg(F.collect_set("item_id").alias("item_ids"))
    hits = (base.filter(F.size("candidates") > 0).select("row_id", F.inline("candidates"))
            .join(exact, ["n", "h1", "h2"])
            .groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("spans"),
                                   F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids")))
    none = F.array().cast(hits.schema["spans"].dataType), F.array().cast(hits.schema["item_ids"].dataType)
    return base.join(hits, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def covered(spans) -> F.Column:
    """How many positions lie in at least one span; spans are sorted by position."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["n"] - F.greatest(a["to"], s["pos"]))).alias("n"),
        F.greatest(a["to"], s["pos"] + s["n"]).alias("to")), lambda a: a["n"])
