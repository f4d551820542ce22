"""Noisy-channel restoration of disguised words.

A word may be disguised by look-alike characters (1d10t), by separators between its letters (i.d.i.o.t,
i d i o t), by repeated letters (idiooot) and by masked letters (id*ot). Every disguised span is a lattice:
each observed character stands for one or more letters, or for none, each at a cost. The path
with the smallest sum of channel costs and of the letters' costs under a character language model is
found by Viterbi's algorithm, whose states are the last three characters. Masks that follow one another, whichever they are, stand for one
letter, once for each. Where masks leave many states the steps are taken with arrays over them (`_decoded_wide`), so a word's time
follows its length. Web and mail addresses, numbers and keys are not taken for disguises.

The language model interpolates the counts of one to four characters of all documents. Counts are kept in a
table of fixed size: its slots are hashes of the character sequences. Characters are the bytes of lower-cased UTF-8;
whatever is no letter is a space.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map
from lexfreq.llm.words import LOWER, SPACED, find_words, flat, slices

ORDER = 4
SLOT_BITS = 21
_SPACE = 0x20

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

# What a look-alike stands for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'/\\"
MASKS = "*#?%"
COSTS = {"look_alike": 0.7, "kept_symbol": 6.0, "dropped_separator": 0.1, "kept_separator": 4.0, "mask": 1.5,
         "squeezed": 0.3, "kept_run": 1.0}

# A word of more digits is a number or a key.
MOST_DIGITS = 8
# Lattices of so many nodes, with one masked place at most, are decoded state by state.
_NARROW_NODES = 256

_ALIKE = np.zeros(256, bool)
_ALIKE[[ord(c) for c in LOOK_ALIKES if ord(c) < 128]] = True
# Look-alikes that may end a word or stand alone among spaced letters.
_TRAILING = np.zeros(256, bool)
_TRAILING[[ord(c) for c in "0123456789@$"]] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in MASKS]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS if c != " "]] = True


def _slots(codes: np.ndarray, order: int) -> np.ndarray:
    """Table slots of character sequences, given as 32-bit numbers."""
    mixed = (codes.astype(np.uint64) + np.uint64(order << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _one_slot(code: int, order: int) -> int:
    return ((code + (order << 32)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)


def character_counts(docs: DataFrame) -> DataFrame:
    """slot and n: the counts of all sequences of one to four characters of all documents.

    Each task adds up its own texts before the shuffle, so a task passes on a row for each
    different sequence it has seen.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for part in slices(batches):
            raw, starts = flat(part["text"])
            low = LOWER[raw]
            chars = np.where(LETTERS[low], low, _SPACE).astype(np.uint32)
            # A space between texts, and one space for several.
            chars = np.insert(chars, starts[:-1], _SPACE)
            chars = chars[~((chars == _SPACE) & np.concatenate([[False], chars[:-1] == _SPACE]))]
            code = chars
            for order in range(1, ORDER + 1):
                if order > 1:
                    code = (code[:-1] << np.uint32(8)) | chars[order - 1:]
                total += np.bincount(_slots(code, order), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    return (arrow_map(docs.select("text"), run, "slot int, n bigint")
            .groupBy("slot").agg(F.sum("n").alias("n")))


def language_model(docs: DataFrame) -> bytes:
    """The table of counts, 8 MiB whatever the size of the corpus."""
    counts = character_counts(docs).toPandas()
    table = np.zeros(1 << SLOT_BITS, np.uint32)
    # Only ratios matter, so counts are scaled down where they would not fit.
    scale = max(1.0, counts["n"].max() / 2**32 * 1.01) if len(counts) else 1.0
    table[counts["slot"].to_numpy(np.int64)] = np.ceil(counts["n"].to_numpy(np.float64) / scale).astype(np.uint32)
    return table.tobytes()


class Restorer:
    """Finds disguised spans in texts and replaces them by their most likely originals."""

    def __init__(self, table: bytes) -> None:
        self.counts = memoryview(table).cast("I")
        self.table = np.frombuffer(table, np.uint32).astype(np.float64)
        self.total = sum(self.counts[_one_slot(c, 1)] for c in range(256))
        self.cost = lru_cache(maxsize=1 << 17)(self._cost)
        self.decoded = lru_cache(maxsize=1 << 16)(self._decoded)

    def _cost(self, context: bytes, char: int) -> float:
        """Minus the logarithm of the probability of a character after up to three others."""
        p = 1 / 256
        for n in range(len(context) + 1):
            before = int.from_bytes(context[len(context) - n:], "big")
            seen = self.counts[_one_slot((before << 8) | char, n + 1)]
            base = self.counts[_one_slot(before, n)] if n else self.total
            p = (seen + 5 * p) / (base + 5)
        return -math.log(min(p, 1.0))

    def _choices(self, span: str) -> list[list[tuple[bytes, float]]]:
        """The lattice: for each observed character, or run of one letter, what it may stand for."""
        lattice = []
        for run in re.finditer(rf"[{re.escape(MASKS)}]+|(.)\1*", span, re.DOTALL):
            char, n = run[0][0], len(run[0])
            own = char.encode()
            if char in SEPARATORS or char in MASKS:
                options = [(b"", COSTS["dropped_separator"] * n), (b" ", COSTS["kept_separator"])]
                if char in MASKS:
                    options += [(bytes([c]) * n, COSTS["mask"] * n) for c in range(0x61, 0x7B)]
                lattice.append(options)
            elif char in LOOK_ALIKES:
                for _ in range(n):
                    lattice.append([*((c.encode(), COSTS["look_alike"]) for c in LOOK_ALIKES[char]), (b" ", COSTS["kept_symbol"])])
            elif char.isalpha():
                if n < 3:
                    lattice.append([(own * n, 0.0)])
                else:
                    lattice.append([(own, COSTS["squeezed"]), (own * 2, COSTS["squeezed"]), (own * n, COSTS["kept_run"])])
            else:
                lattice.append([(b" ", COSTS["kept_symbol"]), (b"", COSTS["kept_symbol"])])
        return lattice

    def _decoded(self, span: str) -> str:
        """Viterbi's algorithm over the lattice."""
        lattice = [*self._choices(span), [(b" ", 0.0)]]
        if len(lattice) > _NARROW_NODES or sum(len(options) > 20 for options in lattice) > 1:
            best = self._decoded_wide(lattice)
        else:
            states = {b" ": (0.0, b"")}
            for options in lattice:
                after: dict[bytes, tuple[float, bytes]] = {}
                for context, (so_far, letters) in states.items():
                    for emitted, price in options:
                        total, state = so_far + price, context
                        for char in emitted:
                            if char == _SPACE and state[-1] == _SPACE:
                                continue
                            total += self.cost(state[-(ORDER - 1):], char)
                            state = (state + bytes([char]))[-(ORDER - 1):]
                        if state not in after or total < after[state][0]:
                            after[state] = (total, letters + emitted)
                states = after
            best = min(states.values())[1]
        return " ".join(best.decode(errors="replace").split())

    def _costs(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The cost of a character in each state. A state is a number: how many characters it has, then these."""
        length = (states >> 24).astype(np.int64)
        context = states & 0xFFFFFF
        p = np.full(len(states), 1 / 256)
        for n in range(ORDER):
            before = context & ((1 << 8 * n) - 1)
            seen = self.table[_slots((before << 8) | chars, n + 1)]
            base = self.table[_slots(before, n)] if n else float(self.total)
            p = np.where(length >= n, (seen + 5 * p) / (base + 5), p)
        return -np.log(np.minimum(p, 1.0))

    def _decoded_wide(self, lattice: list[list[tuple[bytes, float]]]) -> bytes:
        """The same with arrays over the states; of each state the step that led to it is kept."""
        states, costs = np.array([(1 << 24) | _SPACE]), np.zeros(1)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for options in lattice:
            ends, totals, before, chosen = [], [], [], []
            for size in {len(emitted) for emitted, _ in options}:
                # Options that write as many characters are taken together, each from all states.
                own = [i for i, (emitted, _) in enumerate(options) if len(emitted) == size]
                number = np.repeat(own, len(states))
                state, total = np.tile(states, len(own)), np.tile(costs, len(own)) + np.repeat([options[i][1] for i in own], len(states))
                same = all(options[i][0] == options[i][0][:1] * size for i in own)
                for place in range(size):
                    char = np.repeat([options[i][0][place] for i in own], len(states))
                    price = self._costs(state, char)
                    if place >= ORDER and same:
                        # A long run of one letter only meets itself: from here on each costs the same.
                        total = total + (size - place) * price
                        break
                    moves = (char != _SPACE) | (state & 0xFF != _SPACE)
                    length = np.minimum((state >> 24) + 1, ORDER - 1)
                    moved = (length << 24) | (((state & 0xFFFF) << 8) | char) & ((1 << 8 * length) - 1)
                    state, total = np.where(moves, moved, state), np.where(moves, total + price, total)
                ends.append(state)
                totals.append(total)
                before.append(np.tile(np.arange(len(states)), len(own)))
                chosen.append(number)
            state, total = np.concatenate(ends), np.concatenate(totals)
            order = np.lexsort((total, state))
            first = order[np.concatenate([[True], state[order][1:] != state[order][:-1]])]
            steps.append((np.concatenate(before)[first].astype(np.int32), np.concatenate(chosen)[first].astype(np.int8)))
            states, costs = state[first], total[first]
        at, out = int(np.argmin(costs)), []
        for options, (before, chosen) in zip(reversed(lattice), reversed(steps)):
            out.append(options[chosen[at]][0])
            at = int(before[at])
        return b"".join(reversed(out))

    def restore(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts with disguised spans replaced, and how many there were; others are passed on as they are."""
        words = find_words(column, SPACED)
        spans = _disguised(words)
        changed = np.zeros(len(column), np.int64)
        if not len(spans[0]):
            return column, changed
        raw, starts = flat(column)
        raw = raw.tobytes()
        texts = column.to_pylist()
        parts: dict[int, list[bytes]] = {}
        upto: dict[int, int] = {}
        for text, begin, end in zip(*(x.tolist() for x in spans)):
            span = raw[begin:end].decode(errors="replace").lower()
            plain = self.decoded(span)
            if plain == span:
                continue
            parts.setdefault(text, []).extend((raw[upto.get(text, starts[text]):begin], plain.encode()))
            upto[text] = end
            changed[text] += 1
        for text, pieces in parts.items():
            texts[text] = b"".join([*pieces, raw[upto[text]:starts[text + 1]]]).decode(errors="replace")
        return pa.array(texts, pa.string()), changed


def _disguised(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, begin and end of spans that may be disguised, in order.

    A span is a word with a look-alike or mask next to letters, with a letter three times in a row, or
    with separators between four single letters; or it is a chain of four or more one-letter words.
    """
    data, begin, end, text = words.data, words.begin, words.end, words.text
    if not len(begin):
        return text, begin, end
    letter = LETTERS[data]
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    letters = np.concatenate([letter, np.zeros(7, bool)])
    n = len(data)
    # What follows must be in the same word: texts stand side by side in the data.
    last = np.zeros(n + 7, bool)
    last[end - 1] = True
    lasts = np.concatenate([[0], np.cumsum(last)])
    after = letters[1:n + 1] & ~last[:n]
    ascii_letter = letter & (data < 0x80)
    flags = _ALIKE[data] & after
    inner = np.zeros(n, bool)
    inner[1:] = letter[:-1] & ~last[:n - 1]
    masked = _MASK[data] & inner & after
    triple = ascii_letter & (data == padded[1:n + 1]) & (data == padded[2:n + 2]) & ~last[:n] & ~last[1:n + 1]
    apart = _SEPARATOR[padded]
    chain = (letter & apart[1:n + 1] & letters[2:n + 2] & apart[3:n + 3] & letters[4:n + 4] & apart[5:n + 5] & letters[6:n + 6]
             & (lasts[6:n + 6] == lasts[:n]))
    sums = np.concatenate([[0], np.cumsum(flags | masked | triple | chain)])
    odd = sums[end] > sums[begin]
    # A short tail of look-alikes right after a letter (worthle55), not the long ones of junk.
    size = end - begin
    for tail in (1, 2):
        fits = size > tail
        last = end[fits]
        ok = letter[last - tail - 1]
        for i in range(1, tail + 1):
            ok &= _TRAILING[data[last - i]]
        odd[np.flatnonzero(fits)[ok]] = True
    # Web addresses: letters behind a colon and two strokes, or www and a full stop.
    address = (data == 0x3A) & (padded[1:n + 1] == 0x2F) & (padded[2:n + 2] == 0x2F)
    address |= (data == 0x77) & (padded[1:n + 1] == 0x77) & (padded[2:n + 2] == 0x77) & (padded[3:n + 3] == 0x2E)
    # Mail addresses: a full stop and a letter somewhere behind the sign.
    dots = np.concatenate([[0], np.cumsum((data == 0x2E) & after)])
    signs = np.flatnonzero(data == 0x40)
    address[signs] |= dots[end[np.searchsorted(begin, signs, side="right") - 1]] > dots[signs]
    sums = np.concatenate([[0], np.cumsum(address)])
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    odd &= (sums[end] == sums[begin]) & (digits[end] - digits[begin] <= MOST_DIGITS)
    # One character may be several bytes: all but the first are 10xxxxxx.
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = (leads[end] - leads[begin] == 1) & (letter[begin] | _TRAILING[data[begin]])
    linked = single[1:] & single[:-1] & (text[1:] == text[:-1]) & (begin[1:] == end[:-1] + 1)
    heads = single & ~np.concatenate([[False], linked])
    tails = single & ~np.concatenate([linked, [False]])
    first, last = np.flatnonzero(heads), np.flatnonzero(tails)
    long = last - first >= 3
    first, last = first[long], last[long]
    inside = np.zeros(len(begin) + 1, np.int64)
    inside[first] += 1
    inside[last + 1] -= 1
    odd &= np.cumsum(inside[:-1]) == 0
    alone = np.flatnonzero(odd)
    spans = np.concatenate([np.stack([text[alone], begin[alone], end[alone]]), np.stack([text[first], begin[first], end[last]])], axis=1)
    return tuple(spans[:, np.argsort(spans[1], kind="stable")])
