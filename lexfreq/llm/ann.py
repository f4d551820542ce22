"""Operator 2, approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Index: vectors are rotated by a random orthogonal matrix and put into the list of the nearest of about
root-of-N centroids, which k-means finds on a bounded sample. Every vector is in the index.
Search: a query probes the lists whose centroids are nearest. Within a list vectors lie in column blocks; after each block of
columns the distance so far, scaled to all dimensions, is tested against the best found: a candidate is given up
when that estimate exceeds the threshold by more than chance allows (1 + EPSILON / sqrt(columns seen)).
The distances of the ten best are then computed on the original vectors in double precision.

Lists are cut into blocks of about BLOCK_ROWS vectors, so a list that holds a third of all vectors is many tasks; queries stream
through a block in batches. Only the centroids and the sizes of the lists are shared with all tasks; both are bounded by MOST_LISTS.

Defined cases: vectors that are null, zero or of another length than most, or that hold null or non-finite
components, take no part, neither do rows without vec_id. Candidates with the query's own vec_id are left out. Candidates that are alike in
distance go by vec_id. Rows alike in vec_id and vector are one query; rows of one vec_id with different vectors are
several queries with that id. With fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, written

SAMPLE_ROWS = 16_384
MOST_LISTS = 4_096
PROBED_SHARE = 0.55
BLOCK_ROWS = 4_096
COLUMNS = 16
EPSILON = 2.1
NEIGHBOURS = 10


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means; a centroid that loses all its vectors moves to a random one."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(sample, centres, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        for d in range(sample.shape[1]):
            centres[:, d] = np.bincount(own, sample[:, d], minlength=len(centres)) / np.maximum(counts, 1)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = sample[random.choice(len(sample), len(empty))]
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each vector, nearest first."""
    far = -2 * vectors @ centres.T + (centres**2).sum(axis=1)
    if n >= len(centres):
        return np.argsort(far, axis=1, kind="stable")
    some = np.argpartition(far, n, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan(ids: np.ndarray, originals: np.ndarray, turned: np.ndarray, query: np.ndarray, query_turned: np.ndarray,
         own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest vec_ids of a block and their distances; `turned` holds one row per dimension."""
    dims, n = turned.shape
    alive = np.flatnonzero(ids != own_id)
    best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
    for at in range(0, len(alive), 512):
        rows = alive[at:at + 512]
        limit = best[-1]**2 if len(best) == k else np.inf
        so_far = np.zeros(len(rows))
        for d in range(0, dims, COLUMNS):
            block = turned[d:d + COLUMNS, rows] - query_turned[d:d + COLUMNS, None]
            so_far += np.einsum("ij,ij->j", block, block)
            seen = min(d + COLUMNS, dims)
            if np.isfinite(limit) and seen < dims:
                stay = so_far * (dims / seen) <= limit * (1 + EPSILON / np.sqrt(seen))**2
                rows, so_far = rows[stay], so_far[stay]
                if not len(rows):
                    break
        if not len(rows):
            continue
        # A little slack for rounding; the exact distances decide.
        if len(rows) > k:
            edge = max(np.partition(so_far, k - 1)[k - 1], 0.0)
            rows = rows[so_far <= edge * (1 + 1e-6) + 1e-12]
        difference = originals[rows] - query
        exact = np.sqrt(np.einsum("ij,ij->i", difference, difference))
        best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, exact])
        order = np.lexsort((best_ids, best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


def search(vectors: DataFrame, every: int, k: int = NEIGHBOURS, share: float = PROBED_SHARE,
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of every vector whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, total = sizes["dims"], sizes["count"]
    rows = rows.filter(F.size("embedding") == dims)
    turn = rotation(dims)
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample_rows).select("embedding").toPandas()
    sample = np.stack(list(fitted["embedding"])) @ turn
    centres = centroids(sample, max(1, min(MOST_LISTS, round(total**0.5))))
    probes = max(1, int(np.ceil(len(centres) * share)))
    shared = spark.sparkContext.broadcast((turn, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = _nearest(_matrix(part["embedding"]) @ turn, centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists.astype(np.int32))], [*part.schema.names, "list"])

    index = written(arrow_map(rows, assign, "vec_id bigint, embedding array<double>, list int"), "vector_lists")
    counts = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    blocks = {number: -(-n // BLOCK_ROWS) for number, n in counts.items()}
    held = spark.sparkContext.broadcast(blocks)
    sizes = written(spark.createDataFrame(sorted(blocks.items()), "list int, blocks int"), "list_blocks")
    stored = index.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                near = _nearest(_matrix(part["embedding"]) @ turn, centres, probes)
                places = [(i, l, b) for i in range(len(near)) for l in near[i].tolist() for b in range(held.value.get(l, 0))]
                row, lists, block = (np.array(x, np.int32) for x in zip(*places)) if places else (np.zeros(0, np.int32),) * 3
                for cut in range(0, len(row), 4096):
                    own = part.take(pa.array(row[cut:cut + 4096]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists[cut:cut + 4096]), pa.array(block[cut:cut + 4096]),
                         pa.array(np.ones(own.num_rows, np.int32)), own["vec_id"], own["embedding"]],
                        ["list", "block", "asks", "vec_id", "embedding"])

    queries = index.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct()
    asked = arrow_map(queries, probe, stored.schema)
    wide = stored.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "asks", "vec_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        at, parts, block = None, [], None
        for batch in batches:
            lists, numbers, asks = (batch[c].to_numpy() for c in ("list", "block", "asks"))
            ids, vectors = batch["vec_id"].to_numpy(), _matrix(batch["embedding"])
            # Rows of one block and kind stand together.
            new = np.flatnonzero((lists[1:] != lists[:-1]) | (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            found: list[tuple] = []
            for begin, end in zip([0, *new], [*new, batch.num_rows]):
                if begin == end:
                    continue
                place = (lists[begin], numbers[begin])
                if place != at:
                    at, parts, block = place, [], None
                if not asks[begin]:
                    parts.append((ids[begin:end].copy(), vectors[begin:end].copy()))
                    continue
                if block is None and parts:
                    own, originals = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    block = own, originals, np.ascontiguousarray((originals @ turn).T)
                if block is None:
                    continue
                turned = vectors[begin:end] @ turn
                for i in range(begin, end):
                    near, far = scan(*block, vectors[i], turned[i - begin], ids[i], k)
                    found.append((np.full(len(near), ids[i]), np.full(len(near), xxhash.xxh64_intdigest(vectors[i].tobytes()) >> 1), near, far))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)],
                                                 ["query_id", "query_key", "vec_id", "score"])

    found = arrow_map(wide, answer, "query_id bigint, query_key bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
