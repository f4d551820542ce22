"""Words of an unspaced script, by the most probable path through a weighted word list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from lexfreq import fixed_values as V
from lexfreq.operators import trie as T
from lexfreq.session import stored

_HITS = "array<struct<at:int,size:int,weight:bigint>>"
_HIT = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("weight", pa.int64())])


def script_runs(files: DataFrame, script: str = V.HAN, text: str = "text") -> DataFrame:
    """One row per unbroken run of script characters."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{script}]+"), 0)).alias("run"))


def best_sizes(heads: np.ndarray, n: int, at: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every position the size of its step on the path with the largest sum of weights; a longer step wins a tie.

    Hits are sorted by position and size, and every position has one. Nothing crosses the heads, so the sums from each position to the next head
    are found for all of them together, those nearest to it first.
    """
    ends = np.append(heads[1:], n)
    left = ends[np.searchsorted(heads, np.arange(n), side="right") - 1] - np.arange(n)
    order = np.argsort(left[at], kind="stable")
    at, size, weight = at[order], size[order], weight[order]
    levels = np.concatenate([[0], np.cumsum(np.bincount(left[at], minlength=1))])
    # A sum that ends at a head is 0 there, which is not the head's own sum.
    value, chosen, stop = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n + 1, bool)
    stop[ends] = True
    for begin, end in zip(levels[1:-1], levels[2:]):
        if begin == end:
            continue
        own, to = at[begin:end], at[begin:end] + size[begin:end]
        total = weight[begin:end] + np.where(stop[to], 0, value[np.minimum(to, n - 1)])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        most = np.maximum.reduceat(total, first)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        last = np.maximum.reduceat(np.where(total == most[number], np.arange(len(own)), -1), first)
        value[own[first]], chosen[own[first]] = most, size[begin:end][last]
    return chosen


def _path(points: np.ndarray, starts: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], alone: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and sizes of the words on the best paths. A letter that is not listed can stand alone, with the weight `alone`."""
    at, size, weight = hits
    n = len(points)
    single = np.ones(n, bool)
    single[at[size == 1]] = False
    more = np.flatnonzero(single)
    at, size, weight = (np.concatenate(x) for x in ((more, at), (np.ones(len(more), np.int64), size), (np.full(len(more), alone), weight)))
    order = np.lexsort((size, at))
    at, size, weight = at[order], size[order], weight[order]
    heads = T.crossings(starts, at, size, n)
    chosen = best_sizes(heads, n, at, size, weight)
    on = T.followed(heads, n, chosen)
    return on, chosen[on]


def _words(points: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words at these positions, as one array of strings."""
    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([text[a:a + s] for a, s in zip(at.tolist(), size.tolist())], pa.string())


def cut(runs: DataFrame, lexicon: DataFrame, most: int = T.PIECE_WORDS) -> DataFrame:
    """runs(run, others), lexicon(word, weight) -> the same and `words`: the words of the most probable path of each run, in order.

    A run is scanned by the trie of the list; where no listed word crosses from one letter to the next the path falls into parts, which
    are independent, so time is linear in the length of a run. A letter on no path stands alone, with the weight of a word seen
    once. If the list has several pieces, runs go from piece to piece with their hits, and the last one finds the paths.
    """
    figures = lexicon.agg(F.sum("weight").cast("double").alias("total")).first()
    total = math.log(figures.total or 1.0)
    # Whole millionths: sums are exact, so paths that are equally probable tie.
    millionths = F.round((F.log(F.col("weight").cast("double")) - F.lit(total)) * 1_000_000).cast("bigint")
    listed = lexicon.groupBy("word").agg(F.max("weight").alias("weight")).select("word", millionths.alias("millionths"))
    alone = round(-total * 1_000_000)
    pieces = list(T.pieces_of(listed, most)) or [runs.sparkSession.sparkContext.broadcast(
        T.Piece(T.Trie.of(pa.array([], pa.string())), pa.RecordBatch.from_pydict({"word": pa.array([], pa.string()), "millionths": pa.array([], pa.int64())})))]
    found = runs.withColumn("__hits", F.array().cast(_HITS))
    for number, piece in enumerate(pieces):
        last = number == len(pieces) - 1

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = piece, last: bool = last) -> Iterator[pa.RecordBatch]:
            own = sent.value
            weights = own.rows["millionths"].to_numpy()
            for rows in T.text_slices(batches, "run"):
                points, starts = T.letters_of(rows["run"])
                at, size, word = own.trie.found(points, starts)
                before = rows["__hits"].flatten()
                row = np.repeat(np.arange(rows.num_rows), rows["__hits"].value_lengths().to_numpy())
                at = np.concatenate([starts[row] + before.field("at").to_numpy(), at])
                size = np.concatenate([before.field("size").to_numpy(), size])
                weight = np.concatenate([before.field("weight").to_numpy(), weights[word]])
                kept = [rows[c] for c in rows.schema.names if c != "__hits"]
                names = [c for c in rows.schema.names if c != "__hits"]
                if last:
                    on, sizes = _path(points, starts, (at, size, weight), alone)
                    offsets = pa.array(np.searchsorted(on, starts).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, _words(points, on, sizes))], [*names, "words"])
                else:
                    row = np.searchsorted(starts, at, side="right") - 1
                    order = np.argsort(row, kind="stable")
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows.num_rows))]).astype(np.int32)
                    hits = pa.StructArray.from_arrays([pa.array((at - starts[row])[order].astype(np.int32)), pa.array(size[order].astype(np.int32)),
                                                       pa.array(weight[order])], fields=list(_HIT))
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), hits)], [*names, "__hits"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
        found = found.mapInArrow(run, f"{fields}, " + ("words array<string>" if last else f"__hits {_HITS}"))
        if not last:
            found = stored(found, "run_hits")
    return found


def segment_runs(runs: DataFrame, lexicon: DataFrame, most: int = T.PIECE_WORDS) -> DataFrame:
    """runs(run), lexicon(word, weight) -> (run, words), one row per distinct run."""
    return cut(runs.select("run").distinct(), lexicon, most)


def segmented_tokens(files: DataFrame, lexicon: DataFrame, script: str = V.HAN,
                     text: str = "text", most: int = T.PIECE_WORDS) -> DataFrame:
    """files(keys, text) -> (keys, word, frequency). Equal runs of a key are counted before they are cut."""
    runs = script_runs(files, script, text)
    keys = [c for c in runs.columns if c != "run"]
    counted = runs.groupBy(*keys, "run").agg(F.count("*").alias("n"))
    return (cut(counted, lexicon, most).select(*keys, "n", F.explode("words").alias("word"))
            .groupBy(*keys, "word").agg(F.sum("n").alias("frequency")))
