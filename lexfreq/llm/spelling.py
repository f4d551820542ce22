"""Operator 13, spelling variants by pivotal grams.

Runs are maximal sequences of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. Where 31 divides the CRC32 of `<doc_id>:<run>`, the run loses the code
point at that number modulo its length. Words are the different results of at least 7 code points that occur twice or more. Two words are near
if one inserted, deleted or replaced code point makes one the other.

Bigrams are ranked by how many words hold them, the rarest first; there are at most 90^2, so the ranks fit anywhere. A word's prefix is
all its bigrams (with their positions) up to the rank of the third. In it, dynamic programming over the positions finds the pivots: the two
bigrams without a common letter that are rarest together. Of two near words, take the one whose prefix ends at the lower rank. One
edit cannot touch both of its pivots: either it lies behind the left one, which then stands in the other word at the same place with
the same letters before it, or it lies before the right one, which then stands there with the same letters behind it. And a bigram of that rank is in
the other word's prefix. So the letters up to the left pivot, and those from the right pivot on, are looked up among those of all prefix
bigrams, which limits positions to what one edit allows. What remains of the word on the other side differs by the edit alone, so one of its
halves agrees as well and goes into the key (a few rare letters at the beginning or end of a word are common to thousands of words). Nothing is
lost, and what meets is verified by its edit distance.

Counts of words, and near words and forms, are minima, maxima and sums, combined before each shuffle. The chain of forms is followed by
doubling its steps; n grows tenfold at each, so the number of steps is known from the largest n.

Defined cases: null and empty texts have no runs. With a null doc_id no code point is deleted. Repeated rows and doc_ids count each time.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import arrow_map, dropped_shuffles, written
from lexfreq.llm.words import BASES, LOWER, Words, flat, mix, runs, slices, weighted

DELETED = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# The letters a word can have: a to z and U+00C0 to U+00FF.
ALPHABET = np.concatenate([np.arange(0x61, 0x7B), np.arange(0xC0, 0x100)])
_NUMBER = np.zeros(256, np.int64)
_NUMBER[ALPHABET] = np.arange(len(ALPHABET))

# Letters or bytes from which words are rare and may be very long.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def behind(first: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC32 of two strings from that of the first, that of the second and the second's length in bytes."""
    order = np.argsort(-length, kind="stable")
    out, left = first[order], length[order]
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, side="left"))
        out[:n] = (out[:n] >> np.uint32(8)) ^ _CRC[out[:n] & np.uint32(0xFF)]
    shifted = np.empty_like(out)
    shifted[order] = out
    return shifted ^ crc


def find_runs(column: pa.Array) -> Words:
    """Maximal runs of letters, lower-cased in A-Z. The UTF-8 of U+00C0 to U+00FF is the byte C3 and one more."""
    raw, starts = flat(column)
    inside = LETTERS[raw] | (raw == 0xC3)
    inside[1:] |= raw[:-1] == 0xC3
    return runs(LOWER[raw], starts, inside)


def _spelt(part: pa.RecordBatch, least: int, deleted: int) -> tuple[pa.Array, np.ndarray]:
    """The results of a slice's runs that are long enough, and how often each occurs; a result may be listed more than once."""
    words = find_runs(part["text"])
    if not len(words.begin):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    numbers, different = words.encoded()
    points = pc.utf8_length(different.cast(pa.large_string())).to_numpy()
    enough = np.flatnonzero(points >= least)
    place = np.full(len(points), -1)
    place[enough] = np.arange(len(enough))
    numbers = place[numbers]
    own = np.flatnonzero(numbers >= 0)
    numbers, text, points = numbers[own], words.text[own], points[enough]
    octets = (words.end - words.begin)[own]
    different = different.take(pa.array(enough))
    ids = part["doc_id"].to_pylist()
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crcs = np.fromiter(map(zlib.crc32, different.to_pylist()), np.uint32, len(different))
    h = np.zeros(len(own), np.uint32)
    short = octets <= LONG
    h[short] = behind(heads[text[short]], crcs[numbers[short]], octets[short])
    for i in np.flatnonzero(~short):
        h[i] = zlib.crc32(different[int(numbers[i])].as_py(), int(heads[text[i]]))
    cut = (h % deleted == 0) & np.array([i is not None for i in ids], bool)[text]
    counts = np.bincount(numbers[~cut], minlength=len(enough))
    whole = np.flatnonzero(counts)
    cut &= points[numbers] > least
    pairs, n = np.unique(np.stack([numbers[cut], h[cut] % points[numbers[cut]]]), axis=1, return_counts=True)
    shorter = [w[:at] + w[at + 1:] for w, at in zip(different.take(pa.array(pairs[0])).cast(pa.large_string()).to_pylist(), pairs[1].tolist())]
    found = different.take(pa.array(whole)).cast(pa.large_string())
    return pa.concat_arrays([found, pa.array(shorter, pa.large_string())]), np.concatenate([counts[whole], n])


def counted(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED) -> DataFrame:
    """word and n of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, n = _spelt(part, least, deleted)
            yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(n)], ["word", "n"])

    return (arrow_map(docs.select("doc_id", "text"), run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All letters of the words, one after the other, where each word begins, and gram number and word of every bigram, by position."""
    letters = _NUMBER[np.frombuffer("".join(column.to_pylist()).encode("latin-1"), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy())]).astype(np.int64)
    inner = np.ones(len(letters), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    return letters, starts, letters[at] * len(ALPHABET) + letters[at + 1], at


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each bigram is in the words; one number for each pair of letters of the alphabet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.bincount(_grams(batch["word"])[2], minlength=1)
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["gram", "n"])

    counts = np.zeros(len(ALPHABET)**2, np.int64)
    for r in arrow_map(words.select("word"), run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    return counts


def _prefixes(word: np.ndarray, rank: np.ndarray, n_words: int) -> np.ndarray:
    """Which bigrams (by word and position) belong to their word's prefix; every word has three or more."""
    order = np.lexsort((rank, word))
    firsts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])[:-1]
    return rank <= rank[order][firsts + 2][word]


def _pivots(word: np.ndarray, at: np.ndarray, cost: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bigrams of each word without a common letter that cost least together, left and right, as indices.

    From left to right over a word's bigrams: `best` is the cheapest that ends before the last one seen begins, so it or the last one is the
    partner of the next.
    """
    counts = np.bincount(word, minlength=n_words)
    firsts = np.cumsum(counts) - counts
    best, last = np.full(n_words, -1), firsts.copy()
    left, right = np.full(n_words, -1), np.full(n_words, -1)
    least = np.full(n_words, np.iinfo(np.int64).max)
    for k in range(1, int(counts.max()) if len(counts) else 0):
        own = np.flatnonzero(counts > k)
        here, before, partner = firsts[own] + k, last[own], best[own].copy()
        apart = (at[here] - at[before] > 1) & ((partner < 0) | (cost[before] < cost[partner]))
        partner[apart] = before[apart]
        total = cost[here] + cost[partner]
        better = (partner >= 0) & (total < least[own])
        left[own[better]], right[own[better]], least[own[better]] = partner[better], here[better], total[better]
        cheaper = (best[own] < 0) | (cost[before] < cost[best[own]])
        best[own[cheaper]] = before[cheaper]
        last[own] = here
    return left, right


def _keys(sums: np.ndarray, back: np.ndarray, fixed: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray],
          side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys, and which entries have them: the fixed letters with the first or the last half of the rest.

    The rests of two near words differ by one edit, so they agree in the first or in the last half of the longer one. A rest may be that
    one, or be shorter by one; an entry has keys for both.
    """
    def value(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))

    same = value(*fixed) * np.uint64(BASES[0])
    own = rest[1] - rest[0]
    for more in (0, 1):
        longer = own + more
        half = longer // 2
        for last in (0, 1):
            there = np.flatnonzero((longer > 0) & (longer - half <= own) if last else longer > 0)
            begin = (rest[1] - (longer - half) if last else rest[0])[there]
            end = (rest[1] if last else rest[0] + half)[there]
            yield mix(same[there] + value(begin, end) * np.uint64(BASES[1])
                      + (longer[there] * 4 + side * 2 + last).astype(np.uint64)), there


def keyed(words: DataFrame, counts: np.ndarray, pivots: bool, name: str = "word") -> DataFrame:
    """key and the named column of words (which identifies a word): the keys of all words' pivots, or of all bigrams of their prefixes."""
    order = np.lexsort((np.arange(len(counts)), counts))
    ranks = np.empty(len(counts), np.int64)
    ranks[order] = np.arange(len(counts))
    # Bounded by the alphabet.
    sent = words.sparkSession.sparkContext.broadcast((ranks, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cost = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 14):
                named = batch.slice(begin, 1 << 14)[name]
                part = batch.slice(begin, 1 << 14)["word"]
                letters, starts, gram, at = _grams(part)
                word = np.searchsorted(starts, at, side="right") - 1
                own = np.flatnonzero(_prefixes(word, rank[gram], len(part)))
                word, at, gram = word[own], at[own], gram[own]
                left = right = np.arange(len(at))
                if pivots:
                    left, right = _pivots(word, at, cost[gram], len(part))
                forth, back = weighted(len(letters) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * forth[:len(letters)])])
                heads, tails = starts[word], starts[word + 1]
                found = [(key, word[left[there]]) for key, there in _keys(
                    sums, back, (heads[left], at[left] + 2), (at[left] + 2, tails[left]), 0)]
                found += [(key, word[right[there]]) for key, there in _keys(
                    sums, back, (at[right], tails[right]), (heads[right], at[right]), 1)]
                for key, number in found:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), named.take(pa.array(number))], ["key", name])

    kind = words.schema[name].dataType.simpleString()
    return arrow_map(words.select(*dict.fromkeys(["word", name])), run, f"key bigint, {name} {kind}")


def near_words(words: DataFrame) -> DataFrame:
    """word, other: all near words, each pair once (in any order).

    Words go through the join with each of their keys. Those of LONG letters and more, of which a key may have thousands, go as numbers
    and are looked up again for the pairs that met; words of LONG letters go both ways.
    """
    counts = gram_counts(words)

    def met(own: DataFrame, name: str) -> DataFrame:
        probes = keyed(own, counts, True, name).withColumnRenamed(name, "one")
        return probes.join(keyed(own, counts, False, name).withColumnRenamed(name, "other"), "key").filter("one <> other")

    def near(pairs: DataFrame) -> DataFrame:
        return (pairs.filter((F.abs(F.char_length("one") - F.char_length("other")) <= 1) & (F.levenshtein("one", "other", 1) == 1))
                .select(F.least("one", "other").alias("word"), F.greatest("one", "other").alias("other")).distinct())

    length = F.char_length("word")
    long = written(words.filter(length >= LONG).select("word", F.monotonically_increasing_id().alias("number")), "long_words")
    pairs = met(long, "number").select("one", "other").distinct()
    for side in ("one", "other"):
        pairs = (pairs.withColumnRenamed(side, "number").join(long, "number").drop("number").withColumnRenamed("word", side))
    return near(met(words.filter(length <= LONG), "word")).unionByName(near(pairs)).distinct()


def variants(docs: DataFrame, ratio: int = RATIO, **parameters: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words."""
    with dropped_shuffles(docs.sparkSession):
        words = written(counted(docs, **parameters), "words")
        pairs = written(near_words(words), "near_words")
        both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
        counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
        nearest = (both.join(counts, "other").groupBy("word")
                   .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")))
        fits = -F.col("best.less") >= ratio * F.col("n")
        table = written(words.join(nearest, "word", "left").select(
            "word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
        # Every step of a chain has at least `ratio` times the n of the one before.
        most = table.agg(F.max("n")).first()[0] or 1
        steps = max(1, math.ceil(math.log(most) / math.log(ratio))) if ratio > 1 else 64
        roots = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
        for _ in range(max(0, math.ceil(math.log2(steps)))):
            onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
            roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
