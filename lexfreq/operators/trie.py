"""A word list as a trie in arrays, and scans of many texts at once that find every listed word in them.

The list is cut by ranges of its words into pieces of PIECE_WORDS at most; each piece's arrays are built in a task and stored, and
go to the tasks of a scan one by one. So what a task holds is bounded by the parameter, whatever the length of the list.

A scan follows all positions of a batch of texts together, one letter further in each step: positions whose letters begin no listed
word drop out at once, so the steps take the time of the letters and the hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from lexfreq.session import ship_package, stored

PIECE_WORDS = 1 << 18
# Letters of the texts that a scan takes together.
SLICE_LETTERS = 1 << 19
# Steps that are looked up in a table instead of searched: those from the first nodes, which most letters are followed to, in four bytes each.
TABLE_STEPS = 1 << 22


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after the other, and where each text begins; a null is an empty text."""
    listed = pc.fill_null(texts, "")
    points = np.frombuffer("".join(listed.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(pc.utf8_length(listed).to_numpy())]).astype(np.int64)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, letters: int = SLICE_LETTERS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most that many letters, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, side="right")))
            yield batch.slice(at, to - at)
            at = to


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers sorted, each once. By sorting, for NumPy's `unique` hashes them, which takes many times as long."""
    listed = np.sort(numbers)
    new = np.ones(len(listed), bool)
    new[1:] = listed[1:] != listed[:-1]
    return listed[new]


@dataclass
class Trie:
    """Nodes are numbered, the root is 0. A step from a node by a letter is a key of `steps`; `word` says which word ends at a node, or -1."""

    alphabet: np.ndarray
    steps: np.ndarray
    onward: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Trie:
        """The trie of different words that are not empty."""
        points, starts = letters_of(words)
        alphabet, codes = np.unique(points, return_inverse=True)
        size = len(alphabet) + 1
        node, lengths = np.zeros(len(words), np.int64), np.diff(starts)
        steps, onward, nodes = [], [], 1
        for depth in range(int(lengths.max()) if len(lengths) else 0):
            longer = np.flatnonzero(lengths > depth)
            keys, place = np.unique(node[longer] * size + codes[starts[longer] + depth], return_inverse=True)
            steps.append(keys)
            onward.append(nodes + np.arange(len(keys)))
            node[longer] = nodes + place
            nodes += len(keys)
        word = np.full(nodes, -1, np.int64)
        word[node[lengths > 0]] = np.flatnonzero(lengths > 0)
        keys = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        order = np.argsort(keys)
        return cls(alphabet, keys[order], (np.concatenate(onward) if onward else keys)[order], word)

    @cached_property
    def _codes(self) -> np.ndarray:
        """The code of each character up to the last of the alphabet, and -1 at the end; -1 for one that no word has."""
        codes = np.full(int(self.alphabet[-1]) + 2 if len(self.alphabet) else 1, -1, np.int64)
        codes[self.alphabet] = np.arange(len(self.alphabet))
        return codes

    @cached_property
    def _table(self) -> np.ndarray:
        """Where the steps from the first nodes lead, by key, or -1. Nodes are numbered by depth, so these are the ones next to the root."""
        size = len(self.alphabet) + 1
        table = np.full(min(len(self.word), max(1, TABLE_STEPS // size)) * size, -1, np.int32)
        near = int(np.searchsorted(self.steps, len(table)))
        table[self.steps[:near]] = self.onward[:near]
        return table

    def _followed(self, key: np.ndarray) -> np.ndarray:
        """Where the steps lead, or -1. A letter without a code is -1 in its key; no step has such a key, nor one before it."""
        table = self._table
        if len(self.word) * (len(self.alphabet) + 1) <= len(table):
            return table[key].astype(np.int64)
        to = table[np.minimum(key, len(table) - 1)].astype(np.int64)
        far = np.flatnonzero(key >= len(table))
        place = np.minimum(np.searchsorted(self.steps, key[far]), len(self.steps) - 1)
        to[far] = np.where(self.steps[place] == key[far], self.onward[place], -1)
        return to

    def found(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, length and number of every word in the texts that begin at `starts`; sorted by position, shorter words first."""
        size = len(self.alphabet) + 1
        codes = self._codes[np.minimum(points, len(self._codes) - 1)]
        stops = np.repeat(starts[1:], np.diff(starts))
        at, node, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            there = np.flatnonzero(at + depth < stops[at])
            at, node = at[there], node[there]
            to = self._followed(node * size + codes[at + depth])
            good = np.flatnonzero(to >= 0)
            at, node, depth = at[good], to[good], depth + 1
            ends = np.flatnonzero(self.word[node] >= 0)
            hits.append((at[ends], np.full(len(ends), depth), self.word[node[ends]]))
        at, length, word = (np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in range(3))
        # Hits come by length, and of each length by position; a stable sort merges these runs.
        order = np.argsort(at, kind="stable")
        return at[order], length[order], word[order]


@dataclass
class Piece:
    """A piece of a word list: its trie, and the rows of the list in the order of the trie's word numbers."""

    trie: Trie
    rows: pa.RecordBatch


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def pieces_of(words: DataFrame, most: int = PIECE_WORDS) -> Iterator[Broadcast]:
    """The pieces of a list of different words (column `word`, and others that are kept), broadcast one after the other."""
    spark = words.sparkSession
    ship_package(spark)
    listed = stored(words.filter(F.length("word") > 0), "words")
    count = max(1, -(-listed.count() // most))
    dealt = listed.repartitionByRange(count, "word") if count > 1 else listed.coalesce(1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            trie = Trie.of(rows["word"])
            fields = [trie.alphabet, trie.steps, trie.onward, trie.word]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["word"][0].as_py()]), pa.array([[f.astype(np.int64).tobytes() for f in fields]], pa.list_(pa.binary())),
                 pa.array([_packed(rows)], pa.binary())], ["first", "arrays", "rows"])

    built = stored(dealt.mapInArrow(build, "first string, arrays array<binary>, rows binary"), "tries")
    # One piece at a time is on the driver, which hands it to Spark's broadcast.
    for row in built.orderBy("first").toLocalIterator():
        trie = Trie(*[np.frombuffer(bytes(a), np.int64) for a in row.arrays])
        with pa.ipc.open_stream(pa.py_buffer(bytes(row.rows))) as reader:
            rows = reader.read_next_batch()
        yield spark.sparkContext.broadcast(Piece(trie, rows))


def scanned(texts: DataFrame, words: DataFrame, column: str, schema: str,
            take: Callable[[pa.RecordBatch, Piece, np.ndarray, np.ndarray, tuple], Iterator[pa.RecordBatch]], most: int = PIECE_WORDS) -> DataFrame:
    """What `take` makes of every slice of the texts and its hits (rows, piece, letters, starts, hits), for all pieces of the list together."""
    ship_package(texts.sparkSession)
    whole: DataFrame | None = None
    for piece in pieces_of(words, most):
        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = piece) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for rows in text_slices(batches, column):
                points, starts = letters_of(rows[column])
                yield from take(rows, own, points, starts, own.trie.found(points, starts))

        part = texts.mapInArrow(run, schema)
        whole = part if whole is None else whole.unionByName(part)
    return whole if whole is not None else texts.sparkSession.createDataFrame([], schema)


def crossings(starts: np.ndarray, at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Positions that no hit crosses, among them all beginnings of texts; any path of hits and single letters stops at each of them."""
    reach = np.zeros(n + 1, np.int64)
    np.maximum.at(reach, at, at + length)
    before = np.concatenate([[0], np.maximum.accumulate(reach)[:-1]])
    free = before[:n] <= np.arange(n)
    free[starts[:-1][starts[:-1] < n]] = True
    return np.flatnonzero(free)


def followed(heads: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """The positions on the paths that begin at `heads` and go on by the size chosen at each; a path ends where the next one begins."""
    ends = np.append(heads[1:], n)
    on = np.zeros(n, bool)
    at = heads
    while len(at):
        on[at] = True
        at = at + size[at]
        going = at < ends
        at, ends = at[going], ends[going]
    return np.flatnonzero(on)
