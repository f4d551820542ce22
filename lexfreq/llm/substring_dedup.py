"""Operator 11, repeated passages removed by seed and extend.

Words are maximal runs of anything but ASCII white space, unchanged. A window is 13 consecutive words of one document.
Words go that a window covers whose words also start in a document with a smaller doc_id; all windows are judged on the input.

Seeds: winnowing picks an anchor for every window, the smallest (rightmost, if equal) hash of its ten 4-word grams. What stands in
two documents over 13 words has the same anchor at the same place in both, so documents that share a window share a seed: an anchor
that is in more than one of them. Other anchors, two thirds of all in running text, are done with after one aggregation.

Extension: consecutive windows with one anchor are extended together, to the left and right as far as the anchor rules, and make a span of 13
to 22 words. Spans with the same anchor and the same words are a class. A member that is not in the smallest document of its class is a
repeat from end to end, and so the chain of spans is, however long. Only one member of a class, its smallest document, can still hold windows that
other classes share in part, which happens where a maximal repeat ends inside a span: those spans are read again, window by window, if
their anchor has more than one class. No step makes pairs of documents: classes and windows keep their smallest doc_id, which is combined before the
shuffle, and rows are joined to that one row. Words are XXH64 digests; classes and windows agree in 128 bits (anchor and span).

Spans of the removed words are maximal: overlapping and adjoining windows are merged.

Defined cases: a null or empty text has no words and keeps none. A null doc_id is neither smaller nor larger than any other, so such a
document stays whole and removes nothing; nor do rows with the same doc_id from one another. Repeated rows each give their row. Documents
shorter than a window stay whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, dropped_shuffles, written
from lexfreq.llm.words import BASES, SPACED, Words, find_words, grams, mix, slices, weighted

WINDOW = 13
GRAM = 4


def _rulers(words: Words, digests: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of all runs of windows that have one anchor."""
    starts = len(digests) - window + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    values = grams(digests, gram)
    best, where = values[:starts].copy(), np.arange(starts)
    for shift in range(1, window - gram + 1):
        other = values[shift:shift + starts]
        better = other <= best
        best[better] = other[better]
        where[better] = np.flatnonzero(better) + shift
    whole = np.flatnonzero(words.text[:starts] == words.text[window - 1:])
    at = where[whole]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return whole[first], np.diff(np.append(first, len(at))), values[at[first]]


def _hashed(digests: np.ndarray, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A hash of the words from each begin on."""
    forth, back = weighted(len(digests) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests * forth[:len(digests)])])
    return mix((sums[begin + length] - sums[begin]) * back[begin] + np.asarray(length, np.uint64) * np.uint64(BASES[1]))


def _owners(docs: DataFrame) -> DataFrame:
    """Documents that can hold or cause repeats; doc_id and text_key tell all apart whose texts differ."""
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, doc_id: every anchor of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], SPACED, fold=False)
            begin, _, anchor = _rulers(words, words.digests(), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), part["doc_id"].take(pa.array(words.text[begin]))],
                                             ["anchor", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"anchor bigint, doc_id {kind}")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, span (a hash of its words), doc_id, text_key, begin (its first window) and n (windows) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], SPACED, fold=False)
            digests = words.digests()
            begin, n, anchor = _rulers(words, digests, window, gram)
            text = pa.array(words.text[begin])
            place = begin - words.firsts()[words.text[begin]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(_hashed(digests, begin, n + window - 1).view(np.int64)),
                 part["doc_id"].take(text), part["text_key"].take(text), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "span", "doc_id", "text_key", "begin", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"anchor bigint, span bigint, doc_id {kind}, text_key bigint, begin int, n int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """anchor, words (a hash), doc_id, text_key and place of the windows of the listed runs `ends` (begin, n, anchor) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], SPACED, fold=False)
            runs = part["ends"].flatten()
            n = runs.field("n").to_numpy()
            text = np.repeat(np.repeat(np.arange(part.num_rows), part["ends"].value_lengths().to_numpy()), n)
            ends = np.cumsum(n)
            place = np.repeat(runs.field("begin").to_numpy(), n) + np.arange(len(text)) - np.repeat(ends - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(runs.field("anchor").to_numpy(), n)),
                 pa.array(_hashed(words.digests(), words.firsts()[text] + place, window).view(np.int64)),
                 part["doc_id"].take(pa.array(text)), part["text_key"].take(pa.array(text)), pa.array(place.astype(np.int32))],
                ["anchor", "words", "doc_id", "text_key", "place"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return arrow_map(texts, run, f"anchor bigint, words bigint, doc_id {kind}, text_key bigint, place int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key and windows (begin, n: first and number) of all documents with windows that start in a smaller one."""
    own = _owners(docs)
    key = ["doc_id", "text_key"]
    with dropped_shuffles(docs.sparkSession):
        # Partial aggregation leaves a row per task of an anchor that a third of all documents hold.
        seeds = written(anchors(own, window, gram).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                        .filter("lo < hi").select("anchor"), "seeds")
        seeded = written(spans(own, window, gram).join(seeds, "anchor", "left_semi"), "seeded_spans")
        classes = written(seeded.groupBy("anchor", "span").agg(F.min("doc_id").alias("least")), "span_classes")
        several = classes.groupBy("anchor").agg((F.count("*") > 1).alias("several"))
        known = seeded.join(classes.join(several, "anchor"), ["anchor", "span"]).filter("doc_id > least OR several")
        extended = written(known.select(*key, "begin", "n", F.when(F.col("doc_id") == F.col("least"), F.col("anchor")).alias("anchor")),
                           "extended_spans")
        ends = (extended.filter("anchor IS NOT NULL").groupBy(*key)
                .agg(F.collect_set(F.struct("begin", "n", "anchor")).alias("ends")))
        texts = own.join(ends, key).groupBy(*key).agg(F.first("text").alias("text"), F.first("ends").alias("ends"))
        windows = written(_windows(texts.select(*key, "text", "ends"), window), "end_windows")
        least = windows.groupBy("anchor", "words").agg(F.min("doc_id").alias("least"))
        late = windows.join(least, ["anchor", "words"]).filter("doc_id > least").select(*key, F.col("place").alias("begin"), F.lit(1).alias("n"))
        whole = extended.filter("anchor IS NULL").select(*key, "begin", "n")
        return written(whole.unionByName(late).groupBy(*key).agg(F.collect_set(F.struct("begin", "n")).alias("windows")), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by a space) and spans (begin, n: the removed runs of words) of every document."""
    found = repeats(docs, window, gram).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "windows")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    rows = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], SPACED, fold=False)
            firsts, counts = words.firsts(), words.counts()
            listed = part["windows"]
            gone = listed.flatten()
            lengths = np.nan_to_num(listed.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            begin = np.repeat(firsts[:-1], lengths) + gone.field("begin").to_numpy()
            edges = np.zeros(len(words.begin) + 1, np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + gone.field("n").to_numpy() + window - 1, -1)
            removed = np.cumsum(edges)[:-1] > 0
            kept = np.flatnonzero(~removed)
            n_kept = np.bincount(words.text[kept], minlength=words.n_texts)
            text = _joined(words, kept, n_kept)
            opens = removed.copy()
            opens[1:] &= ~removed[:-1] | (words.text[1:] != words.text[:-1])
            heads = np.flatnonzero(opens)
            sizes = np.diff(np.append(np.cumsum(removed)[heads] - 1, removed.sum())) if len(heads) else heads
            offsets = np.concatenate([[0], np.cumsum(np.bincount(words.text[heads], minlength=words.n_texts))])
            runs = pa.StructArray.from_arrays([pa.array(heads - firsts[words.text[heads]]), pa.array(sizes)], ["begin", "n"])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(counts), pa.array(counts - n_kept), text, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)],
                ["doc_id", "n_words", "n_removed", "kept", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows.select("doc_id", "text", "windows"), run,
                     f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<begin:bigint,n:bigint>>")


def _joined(words: Words, kept: np.ndarray, n_kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by a space."""
    begin, end, text = words.begin[kept], words.end[kept], words.text[kept]
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    sizes = end - begin + ~last
    stops = np.cumsum(sizes)
    out = np.full(int(stops[-1]) if len(stops) else 0, 0x20, np.uint8)
    lengths = end - begin
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(stops - sizes, lengths) + inner] = words.data[np.repeat(begin, lengths) + inner]
    offsets = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(n_kept)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(n_kept), pa.py_buffer(offsets), pa.py_buffer(out))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
lo AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
gone AS (SELECT rid, list(DISTINCT p) AS ps
         FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM g JOIN lo USING (s) WHERE least < doc_id) GROUP BY rid),
k AS (SELECT rid, string_agg(w[p], ' ' ORDER BY p) AS kept
      FROM d LEFT JOIN gone USING (rid), unnest(range(1, len(w) + 1)) AS t(p)
      WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN k USING (rid)
"""
