"""Words of Arrow string columns, found and hashed for a whole batch at once with NumPy.

A batch is taken in slices of a bounded number of text bytes, so memory follows the slice (or the
one text that is longer than a slice), not the batch. All classes of word characters used here
hold every non-ASCII character or none, so UTF-8 bytes can be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

ALPHANUMERIC = np.ones(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALPHANUMERIC[low:high + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# Odd multipliers of the polynomial hashes; any random odd numbers would do.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the bases and of their inverses modulo 2^64, grown as texts need them."""

    def __init__(self) -> None:
        self.forth: list[np.ndarray] = []
        self.back: list[np.ndarray] = []

    def upto(self, n: int) -> None:
        if self.forth and len(self.forth[0]) >= n:
            return
        n = max(n, SLICE_BYTES + 1)
        self.forth, self.back = [], []
        for base in BASES:
            for number, out in ((base, self.forth), (pow(base, -1, 1 << 64), self.back)):
                steps = np.full(n, number & _MASK, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))


_powers = _Powers()


def weighted(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a base and of its inverse."""
    _powers.upto(n)
    return _powers.forth[base], _powers.back[base]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; a null is an empty text."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


@dataclass
class Words:
    """Words of several texts: byte range and text number of each, and the bytes in lower case."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    n_texts: int
    _sums: dict

    def hashes(self, base: int = 0, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of the first `length` bytes of it."""
        if base not in self._sums:
            _powers.upto(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers.forth[base][:len(self.data)],
                      out=sums[1:])
            self._sums[base] = sums
        sums = self._sums[base]
        end = self.end if length is None else np.minimum(self.end, self.begin + length)
        own = (sums[end] - sums[self.begin]) * _powers.back[base][self.begin]
        return mix(own + (end - self.begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """The number of every word among the different words, and those words as bytes."""
        ends = np.cumsum(self.end - self.begin)
        starts = np.concatenate([[0], ends]).astype(np.int64)
        joined = self.data[np.repeat(self.begin - starts[:-1], np.diff(starts)) + np.arange(starts[-1])]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(joined)])
        found = words.dictionary_encode()
        return found.indices.to_numpy(), found.dictionary

    def digests(self) -> np.ndarray:
        """The XXH64 of every word. Unlike the polynomials of `hashes` it has no algebra by which long words could be made to agree."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        numbers, different = self.encoded()
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w) for w in different.to_pylist()), np.uint64, len(different))[numbers]

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def firsts(self) -> np.ndarray:
        """The number of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())]).astype(np.int64)


def find_words(column: pa.Array, kind: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of bytes of a kind, in lower case unless `fold` is off; they never cross from one text to the next."""
    raw, starts = flat(column)
    if fold:
        raw = LOWER[raw]
    return runs(raw, starts, kind[raw])


def runs(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes that are inside; they never cross from one text to the next."""
    opens, closes = inside.copy(), inside.copy()
    if len(raw):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        heads = starts[:-1][starts[:-1] < len(raw)]
        opens[heads] = inside[heads]
        tails = heads[heads > 0] - 1
        closes[tails] = inside[tails]
    begin = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    text = np.searchsorted(starts, begin, side="right") - 1
    return Words(raw, begin, end, text, len(starts) - 1, {})


def grams(hashes: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """The hash of the n words that begin at each word; the last n-1 entries are left out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    multiplier = np.uint64(BASES[base])
    out = hashes[:count].copy()
    for i in range(1, n):
        out = out * multiplier + hashes[i:i + count]
    return mix(out + np.uint64(n))
