"""Operator 12, ranked lexical search by a dual-tree search.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. A document's score for an item is the
sum over the item's terms, repeats included, of the term's weight times its impact in the document; all of it is integer arithmetic (see the functions
`weights` and `impacts`). Each item gets its k documents with the highest scores above 0, equal scores by ascending doc_id.

Two hierarchies. Documents are kept as vectors of impacts over the items' terms. Those of a task are put in order by their terms of
highest weighted impact, so that neighbours share rare terms, cut into leaves, and these into nodes; every node holds the coordinate
maxima of what is below it. Items are put in order by their heaviest terms likewise, and their nodes hold the maxima of their weighted
counts. The product of the maxima of a document node and an item node is at least any score between them.

Search. The k-th best score that an item has anywhere is a bound for its k-th best in all. In a first pass each tree only gives the scores of one leaf per
item, the one with the highest bound; the k-th best of these over all trees is the item's first threshold. The second pass goes down
both hierarchies from every tree's root, and drops a pair of nodes whose bound is below the smallest threshold of its items; what is left at the
leaves is scored, and thresholds of the task rise with it. A pair is only dropped when no score in it can reach the weakest k-th, so
results are exact. Every tree returns at most k documents per item.

Items are taken in blocks: as many as have ITEM_TERMS distinct terms at most between them (a single item may have more). What a block sends to the tasks
is bounded by that, and each block is a pass over the stored vectors; so neither the number of items nor their lengths are limited. Scores are
computed in doubles, which hold whole numbers below 2^53 exactly, or in 64-bit integers for items whose scores could reach that.

Defined cases: null and empty texts have no terms; such documents are not counted and never found, such items get no rows. Items are told apart by row, so
items with the same or no item_id each get their ranks. Null doc_ids come last among equals; rows with one doc_id are ranked one after the other.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, written
from lexfreq.llm.words import ALPHANUMERIC, find_words, slices

K = 20
ITEM_TERMS = 1 << 15
# Documents of a tree, and cells of its dense matrix (documents times terms of the block), at most.
TREE = 4096
CELLS = 1 << 23
LEAF = 32
FAN = 8
ITEM_LEAF = 4
EXACT = 1 << 53


def terms(rows: DataFrame, key: str) -> DataFrame:
    """key, n (terms with repeats), terms and tfs (how often) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = find_words(part["text"], ALPHANUMERIC)
            numbers, different = words.encoded() if len(words.begin) else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
            size = max(1, len(different))
            pairs, tf = np.unique(words.text * size + numbers, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs // size, minlength=words.n_texts))]).astype(np.int32)
            found = different.cast(pa.large_string()).cast(pa.string()).take(pa.array(pairs % size))
            yield pa.RecordBatch.from_arrays(
                [part[key], pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(offsets), found),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int64)))], [key, "n", "terms", "tfs"])

    kind = rows.schema[key].dataType.simpleString()
    return arrow_map(rows.select(key, "text"), run, f"{key} {kind}, n bigint, terms array<string>, tfs array<bigint>")


def item_blocks(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[list[tuple[int, object, dict[str, int]]]]:
    """Blocks of items (row number, item_id, count by term) that have at most that many distinct terms each, item by item from the table."""
    own = written(terms(items, "item_id").filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "item_terms")
    block: list[tuple[int, object, dict[str, int]]] = []
    seen: set[str] = set()
    for r in own.toLocalIterator():
        counts = dict(zip(r.terms, r.tfs))
        if block and len(seen | counts.keys()) > most:
            yield block
            block, seen = [], set()
        block.append((r.row, r.item_id, counts))
        seen |= counts.keys()
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n (all terms with repeats) and, for the terms listed, numbers and tfs of every document that has a term at all."""
    listed = docs.sparkSession.sparkContext.broadcast({term.encode(): number for term, number in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        for part in slices(batches):
            words = find_words(part["text"], ALPHANUMERIC)
            counts = words.counts()
            own, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(words.begin):
                codes, different = words.encoded()
                number = np.fromiter((known.get(w, -1) for w in different.to_pylist()), np.int64, len(different))[codes]
                own = np.flatnonzero(number >= 0)
            size = max(1, len(known))
            pairs, tf = np.unique(words.text[own] * size + number[own], return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs // size, minlength=words.n_texts))]).astype(np.int32)
            batch = pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs % size).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32)))], ["doc_id", "n", "numbers", "tfs"])
            yield batch.filter(pc.greater(batch["n"], 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, numbers array<int>, tfs array<int>")


def weights(df: Column, n_docs: int) -> Column:
    """The weight of a term that df of n_docs documents hold."""
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * df + 1))).cast("bigint")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of a term that occurs tf times in a document of n terms."""
    m = 75 + 25 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Hierarchy:
    """Levels of nodes, the leaves first: where the members of each node begin in the level below, and the coordinate maxima as dense rows."""

    begins: list[np.ndarray]
    maxima: list[np.ndarray]


def _levels(rows: np.ndarray, leaf: int, fan: int) -> Hierarchy:
    begins, maxima, below, step = [], [], rows, leaf
    while True:
        cuts = np.arange(0, len(below), step)
        begins.append(np.append(cuts, len(below)))
        below = np.maximum.reduceat(below, cuts, axis=0)
        maxima.append(below)
        if len(below) == 1:
            return Hierarchy(begins, maxima)
        step = fan


class Block:
    """A block of items as the tasks get it: term numbers, weighted counts, and their hierarchy."""

    def __init__(self, items: list[tuple[int, object, dict[str, int]]], vocabulary: dict[str, int], weight: np.ndarray) -> None:
        self.n_terms = len(vocabulary)
        self.rows = []
        for _, _, counts in items:
            number = np.array(sorted(vocabulary[t] for t in counts), np.int64)
            by = {vocabulary[t]: n for t, n in counts.items()}
            self.rows.append((number, np.array([by[x] for x in number], np.int64) * weight[number]))
        largest = max((int(v.sum()) for _, v in self.rows), default=0)
        self.kind = np.float64 if largest * 1_000_000 < EXACT else np.int64
        self.order = self._order()
        self.nodes = self._tree()

    def _order(self) -> list[int]:
        """Items by their terms of highest weight, so that neighbours have rare terms in common."""
        heavy = [tuple(number[np.argsort(-value, kind="stable")[:3]].tolist()) for number, value in self.rows]
        return sorted(range(len(self.rows)), key=lambda i: (heavy[i], i))

    def _tree(self) -> list[list[tuple]]:
        """Levels from the leaves up: (first item, end in `order`, term numbers, maxima, children)."""
        levels, level = [], []
        for at in range(0, len(self.order), ITEM_LEAF):
            level.append(self._node(at, min(at + ITEM_LEAF, len(self.order)), [self.rows[i] for i in self.order[at:at + ITEM_LEAF]], ()))
        levels.append(level)
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN):
                part = level[at:at + FAN]
                above.append(self._node(part[0][0], part[-1][1], [(p[2], p[3]) for p in part], tuple(range(at, at + len(part)))))
            levels.append(above)
            level = above
        return levels

    def _node(self, begin: int, end: int, parts: list[tuple[np.ndarray, np.ndarray]], children: tuple) -> tuple:
        numbers = np.unique(np.concatenate([p[0] for p in parts]))
        maxima = np.zeros(len(numbers), np.int64)
        for number, value in parts:
            at = np.searchsorted(numbers, number)
            maxima[at] = np.maximum(maxima[at], value)
        return begin, end, numbers, maxima, children


class Tree:
    """The documents of one row of the stored trees, with their hierarchy; columns are terms that occur in it."""

    def __init__(self, numbers: np.ndarray, value: np.ndarray, offsets: np.ndarray, n_terms: int, kind: type) -> None:
        n = len(offsets) - 1
        self.there, column = np.unique(numbers, return_inverse=True)
        self.column = np.full(n_terms, -1, np.int64)
        self.column[self.there] = np.arange(len(self.there))
        dense = np.zeros((n, len(self.there) + 1), kind)
        dense[np.repeat(np.arange(n), np.diff(offsets)), column] = value
        self.levels = _levels(dense, LEAF, FAN)
        self.dense = dense

    def columns(self, numbers: np.ndarray) -> np.ndarray:
        """Columns of terms; a term that no document has is the last, which holds zeros."""
        return self.column[numbers]


class Best:
    """The k best documents of every item so far in a task, and the thresholds that follow."""

    def __init__(self, thresholds: np.ndarray, k: int) -> None:
        self.k, self.least = k, np.maximum(thresholds, 1)
        self.heaps: list[list[int]] = [[] for _ in thresholds]

    def take(self, item: int, scores: np.ndarray) -> None:
        """Scores of further documents; only the k best raise the threshold."""
        heap = self.heaps[item]
        for s in scores.tolist():
            if len(heap) < self.k:
                heapq.heappush(heap, s)
            elif s > heap[0]:
                heapq.heapreplace(heap, s)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0])


def _search(tree: Tree, block: Block, best: Best, only_first: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Item, documents and scores: all that could be among the item's k best."""
    top = len(block.nodes) - 1
    roots = [(top, i, np.arange(len(tree.levels.maxima[-1])), len(tree.levels.maxima) - 1) for i in range(len(block.nodes[top]))]
    while roots:
        height, at, docs, level = roots.pop()
        begin, end, numbers, maxima, children = block.nodes[height][at]
        least = min(best.least[block.order[i]] for i in range(begin, end))
        columns = tree.columns(numbers)
        bounds = tree.levels.maxima[level][docs][:, columns] @ maxima.astype(block.kind)
        keep = bounds >= least
        docs, bounds = docs[keep], bounds[keep]
        if not len(docs):
            continue
        if height:
            # Items go down first: their maxima are the looser ones.
            roots += [(height - 1, c, docs, level) for c in children]
        elif level:
            below = tree.levels.begins[level]
            inner = np.concatenate([np.arange(below[d], below[d + 1]) for d in docs])
            roots.append((height, at, inner, level - 1))
        else:
            if only_first:
                docs = docs[[int(np.argmax(bounds))]]
            else:
                docs = docs[np.argsort(-bounds, kind="stable")]
            below = tree.levels.begins[0]
            for d in docs:
                rows = np.arange(below[d], below[d + 1])
                for i in (block.order[j] for j in range(begin, end)):
                    number, value = block.rows[i]
                    scores = tree.dense[rows][:, tree.columns(number)] @ value.astype(block.kind)
                    good = scores >= best.least[i]
                    if good.any():
                        best.take(i, scores[good])
                        yield i, rows[good], scores[good].astype(np.int64)


def trees(stored: DataFrame, n_docs: int, n_terms: int, weight: np.ndarray) -> DataFrame:
    """doc_ids, numbers, impacts and offsets of the documents of each tree, similar ones next to one another."""
    heavy = stored.sparkSession.sparkContext.broadcast(weight)
    size = max(LEAF, min(TREE, CELLS // max(1, len(weight))))

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        offsets = np.concatenate([[0], np.cumsum(whole["numbers"].value_lengths().to_numpy())]).astype(np.int64)
        numbers = whole["numbers"].flatten().to_numpy().astype(np.int64)
        tf = whole["tfs"].flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(whole.num_rows), np.diff(offsets))
        value = impacts(tf, whole["n"].to_numpy()[row], n_docs, n_terms)
        # Each document's terms by weighted impact; its first three decide where it stands.
        by = np.lexsort((numbers, -value * heavy.value[numbers], row))
        place = np.arange(len(row)) - offsets[:-1][row]
        first = np.full((3, whole.num_rows), -1, np.int64)
        for i in range(3):
            at = place == i
            first[i, row[at]] = numbers[by][at]
        order = np.lexsort(first[::-1])
        lengths = np.diff(offsets)[order]
        ends = np.cumsum(lengths)
        take = np.repeat(offsets[:-1][order] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        listed = [whole["doc_id"].take(pa.array(order)), pa.array(numbers[take].astype(np.int32)), pa.array(value[take].astype(np.int32)),
                  pa.array(np.concatenate([[0], ends]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in listed], ["doc_ids", "numbers", "impacts", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, size - waiting)
                batch = batch.slice(own.num_rows)
                parts.append(own)
                waiting += own.num_rows
                if waiting == size:
                    yield packed(parts)
                    parts, waiting = [], 0
        if parts:
            yield packed(parts)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return arrow_map(stored, run, f"doc_ids array<{kind}>, numbers array<int>, impacts array<int>, offsets array<int>")


def _pass(stored: DataFrame, kind: str, block: Block, thresholds: np.ndarray, k: int, only_first: bool) -> DataFrame:
    """item (its place in the block), doc_id and score of each tree's best documents."""
    sent = stored.sparkSession.sparkContext.broadcast((block, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = sent.value
        best = Best(least.copy(), k)
        for batch in batches:
            for at in range(batch.num_rows):
                lists = [batch[c].slice(at, 1).flatten() for c in ("doc_ids", "numbers", "impacts", "offsets")]
                numbers, value, offsets = (x.to_numpy().astype(np.int64) for x in lists[1:])
                if not len(numbers):
                    continue
                tree = Tree(numbers, value, offsets, own.n_terms, own.kind)
                found = list(_search(tree, own, best, only_first))
                if not found:
                    continue
                item = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                docs, scores = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                ids = lists[0].take(pa.array(docs))
                rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
                order = np.lexsort((rank, -scores, item))
                head = np.concatenate([[True], item[order][1:] != item[order][:-1]])
                place = np.arange(len(order)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                order = order[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[order].astype(np.int32)), ids.take(pa.array(order)), pa.array(scores[order])], ["item", "doc_id", "score"])

    return arrow_map(stored, run, f"item int, doc_id {kind}, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every item."""
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    results = None
    for block in item_blocks(items, most_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, c in block for t in c}))}
        own = written(vectors(docs, vocabulary), "document_vectors")
        totals = own.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        counted = own.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
        weight = np.zeros(len(vocabulary), np.int64)
        # One row per term of the block, which are bounded.
        for r in counted.select("number", weights(F.col("df"), totals.docs).alias("weight")).toLocalIterator():
            weight[r.number] = r.weight
        stored = written(trees(own.filter(F.size("numbers") > 0), totals.docs, totals.terms or 0, weight), "document_trees")
        sent = Block(block, vocabulary, weight)
        none = np.zeros(len(block), np.int64)
        first = _ranked(_pass(stored, kinds[0], sent, none, k, True), k).filter(F.col("rank") == k).select("item", "score")
        thresholds = none.copy()
        for r in first.toLocalIterator():
            thresholds[r.item] = r.score
        best = _ranked(_pass(stored, kinds[0], sent, thresholds, k, False), k)
        names = written(spark.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(block)], f"item int, item_id {kinds[1]}"), "item_names")
        rows = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        results = rows if results is None else results.unionByName(written(rows, "ranked"))
    if results is None:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
    return results


ORACLE = r"""
WITH t AS (
  SELECT rid, doc_id, unnest(w) AS term, len(w) AS n FROM (
    SELECT row_number() OVER () AS rid, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
f AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY rid, term),
total AS (SELECT count(DISTINCT rid) AS n_docs, count(*) AS n_terms FROM t),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, total GROUP BY term),
q AS (
  SELECT iid, item_id, unnest(w) AS term FROM (
    SELECT row_number() OVER () AS iid, item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
s AS (
  SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN weight USING (term), total GROUP BY iid, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
