"""Transcript cleaning: repeated passages, script conversion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from lexfreq import fixed_values as V
from lexfreq.functions import text as X
from lexfreq.operators import trie as T
from lexfreq.session import stored


# Characters that are compared together. Whole texts, so it bounds a task's memory and says nothing of the result.
BATCH_CHARS = 1 << 19


def collapse_repeats(text: Column, shortest: int = V.REPEAT_SHORTEST,
                     longest: int = V.REPEAT_LONGEST) -> Column:
    """Keep one copy of any span that is immediately repeated, trying long spans first.

    A regex with a back-reference says the same, but tries every length at every character. Here
    the characters of a batch of texts are compared with themselves, shifted by each length, at so
    few places that no repeat can fall between them. Whole texts; a repeat never crosses two texts.
    """
    batch_chars = BATCH_CHARS

    def collapse(texts):
        import numpy as np

        ends = np.cumsum([len(t) + 1 for t in texts])
        # A code of its own behind each text: no repeat can reach over it.
        joined = np.empty(int(ends[-1]), dtype=np.uint32)
        begin = 0
        for number, (t, end) in enumerate(zip(texts, ends)):
            joined[begin:end - 1] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            joined[end - 1] = 0x110000 + number
            begin = end
        size = len(joined)
        width = min(shortest, 4)
        gram = np.zeros(max(size - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            gram ^= joined[k:size - width + 1 + k].astype(np.uint64) << np.uint64(16 * k)
        best = np.zeros(size, dtype=np.int32)

        def equal_until(start, shift):
            """First place from start on where the text differs from itself shifted."""
            at, window = start, 64
            while at + shift < size:
                stop = min(at + window, size - shift)
                differs = np.flatnonzero(joined[at:stop] != joined[at + shift:stop + shift])
                if len(differs):
                    return at + int(differs[0])
                at, window = stop, window * 4
            return at

        def equal_since(start, shift):
            at, window = start, 64
            while at > 0:
                low = max(at - window, 0)
                differs = np.flatnonzero(joined[low:at] != joined[low + shift:at + shift])
                if len(differs):
                    return low + int(differs[-1]) + 1
                at, window = low, window * 4
            return at

        for shift in range(shortest, longest + 1):
            # A stretch of `shift` equal characters holds a gram at a multiple of this step.
            step = shift - width + 1
            here = gram[:max(len(gram) - shift, 0):step]
            hits = np.flatnonzero(here == gram[shift::step][:len(here)]) * step
            done = 0
            for place in hits:
                if place < done:
                    continue
                done = equal_until(int(place), shift)
                since = equal_since(int(place), shift)
                if done - since >= shift:
                    best[since:done - shift + 1] = shift
        starts = np.flatnonzero(best)

        cleaned, begin = [], 0
        for t, end in zip(texts, ends):
            low, high = np.searchsorted(starts, (begin, end))
            kept, at = [], 0
            while low < high:
                place = int(starts[low]) - begin
                span = int(best[starts[low]])
                kept.append(t[at:place + span])
                at = place + span
                while t[at:at + span] == t[at - span:at]:
                    at += span
                low += int(np.searchsorted(starts[low:high], begin + at))
            kept.append(t[at:])
            cleaned.append("".join(kept))
            begin = end
        return cleaned

    def run(batch: pd.Series) -> pd.Series:
        result, group, chars = [], [], 0
        values = batch.tolist()
        for i, value in enumerate(values):
            if value is not None:
                group.append(i)
                chars += len(value)
            if group and (chars >= batch_chars or i == len(values) - 1):
                for j, text_out in zip(group, collapse([values[j] for j in group])):
                    values[j] = text_out
                group, chars = [], 0
        return pd.Series(values, dtype="object")

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returnType=StringType())(text)


def collapse_clause_blocks(parts: Column, longest_block: int = V.CLAUSE_BLOCK,
                           shortest_single: int = V.CLAUSE_SHORTEST,
                           similarity: float = V.CLAUSE_SIMILARITY) -> Column:
    """Drop clause blocks that repeat the block right before them, exactly or nearly.

    The scan is greedy: what counts as the next block depends on what was dropped before, which
    column expressions cannot say. Each row is handled on its own.
    """

    buckets = 64

    def near(parts):
        """For each distance, which clauses share enough letters with the clause so far behind.

        Letters fall into buckets, which can only raise the shared number: an upper bound.
        """
        import numpy as np

        sizes = np.array([len(p) for p in parts])
        letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(parts)), sizes)
        held = np.bincount(owner * buckets + letters % buckets, minlength=len(parts) * buckets)
        held = held.reshape(len(parts), buckets)
        possible = {}
        for gap in range(1, min(longest_block, len(parts) // 2) + 1):
            shared = np.minimum(held[:-gap], held[gap:]).sum(axis=1)
            # A little slack keeps rounding from ruling out a pair that is exactly at the limit.
            possible[gap] = 2 * shared >= similarity * (sizes[:-gap] + sizes[gap:]) - 1e-6
        return possible

    def collapse(parts):
        from difflib import SequenceMatcher

        possible = near(parts)
        seen: dict[tuple[int, int], bool] = {}
        places: dict[int, dict[str, int]] = {}

        def common(a: int, b: int) -> int:
            """Length of the longest common subsequence (bit-parallel): matching blocks are one."""
            if a not in places:
                bits = places[a] = {}
                for i, letter in enumerate(parts[a]):
                    bits[letter] = bits.get(letter, 0) | 1 << i
            bits, full = places[a], (1 << len(parts[a])) - 1
            row = full
            for letter in parts[b]:
                hit = row & bits.get(letter, 0)
                row = ((row + hit) | (row - hit)) & full
            return len(parts[a]) - row.bit_count()

        def alike(a: int, b: int) -> bool:
            if not possible[b - a][a]:
                return False
            known = seen.get((a, b))
            if known is None:
                one, two = parts[a], parts[b]
                known = one == two or (
                    2 * common(a, b) >= similarity * (len(one) + len(two)) - 1e-6
                    and SequenceMatcher(None, one, two).ratio() >= similarity)
                seen[(a, b)] = known
            return known

        # For every distance, how many clauses in a row are alike from each clause on: a block of n clauses
        # comes again right behind itself where that run, at distance n, is n long or longer.
        count = len(parts)
        runs = {}
        for gap in possible:
            run = runs[gap] = [0] * (count + 1)
            for place in range(count - gap - 1, -1, -1):
                run[place] = run[place + 1] + 1 if alike(place, place + gap) else 0

        def block_at(place: int) -> int:
            """The longest block that begins here and comes again; 0 if there is none."""
            return next((gap for gap in sorted(runs, reverse=True) if runs[gap][place] >= gap
                         and (gap > 1 or len(parts[place]) >= shortest_single)), 0)

        kept, place = [], 0
        while place < count:
            block = block_at(place)
            kept += parts[place:place + max(block, 1)]
            # A run of r alike clauses at the distance of the block covers r // block further copies.
            place += block * (1 + runs[block][place] // block) if block else 1
        return kept

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda parts: None if parts is None else collapse(list(parts)))

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returnType=ArrayType(StringType()))(parts)


def dedupe_transcripts(files: DataFrame, listening: Column, text: str = "text",
                       output: str = "text_clean") -> DataFrame:
    """Remove immediate repeats from listening rows; other rows pass through.

    Only listening rows hand their text to Python, and only those with two clauses or more hand
    over an array; all other rows hand over a null.
    """
    exact = files.withColumn("__exact", collapse_repeats(F.when(listening, F.col(text))))
    split = exact.withColumn("__clauses", X.clauses(F.col("__exact")))
    fuzzy = split.withColumn(
        "__kept", collapse_clause_blocks(F.when(F.size("__clauses") > 1, F.col("__clauses"))))
    cleaned = F.array_join(F.coalesce(F.col("__kept"), F.col("__clauses")), "")
    return (fuzzy.withColumn(output, F.coalesce(cleaned, F.col(text)))
            .drop("__exact", "__clauses", "__kept"))


def character_pairs(dictionary: DataFrame, traditional: str = "traditional",
                    simplified: str = "simplified") -> DataFrame:
    """One replacement per character, from dictionary entries of equal length.

    A character with several replacements takes the most frequent one.
    """
    same = dictionary.filter((F.length(traditional) == F.length(simplified))
                             & (F.col(traditional) != F.col(simplified)))
    pairs = (same.select(F.explode(F.arrays_zip(X.characters(F.col(traditional)).alias("a"),
                                                X.characters(F.col(simplified)).alias("b"))).alias("p"))
             .select(F.col("p.a").alias("source"), F.col("p.b").alias("target"))
             .filter("source <> target")
             .groupBy("source", "target").agg(F.count("*").alias("n")))
    return pairs.groupBy("source").agg(
        F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("target"))


def simplify_text(text: Column, pairs: DataFrame) -> Column:
    """Replace characters by the pairs table, read as a scalar subquery.

    The table holds at most one row per character that exists, which bounds the two strings.
    """
    listed = F.array_sort(F.collect_list(F.struct("source", "target")))
    both = pairs.agg(F.struct(
        F.array_join(F.transform(listed, lambda p: p["source"]), "").alias("source"),
        F.array_join(F.transform(listed, lambda p: p["target"]), "").alias("target"))).scalar()
    return F.call_function("translate", text, both["source"], both["target"])


def phrase_pairs(dictionary: DataFrame, pairs: DataFrame, traditional: str = "traditional",
                 simplified: str = "simplified") -> DataFrame:
    """(word, target): dictionary phrases of two characters or more with their conversion, and single characters from `pairs`.

    A phrase that stays as it is is listed too: it keeps its characters from being converted one by one.
    """
    phrases = (dictionary.filter(F.length(traditional) > 1)
               .groupBy(F.col(traditional).alias("word")).agg(F.min(simplified).alias("target")))
    return phrases.unionByName(pairs.select(F.col("source").alias("word"), "target"))


def _longest(starts: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, size and word (-1: none) of the steps through all texts that take the longest word wherever one begins."""
    at, size, word = hits
    longest, number = np.ones(n, np.int64), np.full(n, -1)
    # Sorted by position and size, so the longest word of a position is written last.
    last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else at
    longest[at[last]], number[at[last]] = size[last], word[last]
    on = T.followed(T.crossings(starts, at, size, n), n, longest)
    return on, longest[on], number[on]


def convert_phrases(files: DataFrame, phrases: DataFrame, text: str = "text", output: str = "text", most: int = T.PIECE_WORDS) -> DataFrame:
    """Convert running text: from left to right the longest listed phrase (word, target) that begins at a place is replaced as a whole.

    Texts are scanned by the trie of the phrases. If the list has several pieces, the hits of all of them go with the text, and the last
    one chooses between them.
    """
    kind = "array<struct<at:int,size:int,target:string>>"
    arrow_hit = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("target", pa.string())])
    pieces = list(T.pieces_of(phrases.groupBy("word").agg(F.min("target").alias("target")), most))
    if not pieces:
        return files.withColumn(output, F.col(text))
    others = [f for f in files.schema.fields if f.name != output]
    found = files.select(*[f.name for f in others], F.col(text).alias("__text"), F.array().cast(kind).alias("__hits"))
    for place, piece in enumerate(pieces):
        last = place == len(pieces) - 1

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = piece, last: bool = last) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for rows in T.text_slices(batches, "__text"):
                points, starts = T.letters_of(rows["__text"])
                at, size, word = own.trie.found(points, starts)
                before = rows["__hits"].flatten()
                row = np.repeat(np.arange(rows.num_rows), rows["__hits"].value_lengths().to_numpy())
                targets = pa.concat_arrays([before.field("target"), own.rows["target"].take(pa.array(word))])
                at = np.concatenate([starts[row] + before.field("at").to_numpy(), at])
                size = np.concatenate([before.field("size").to_numpy(), size])
                order = np.lexsort((size, at))
                at, size, targets = at[order], size[order], targets.take(pa.array(order))
                kept = [rows[f.name] for f in others]
                names = [f.name for f in others]
                if last:
                    converted = _replaced(points, starts, _longest(starts, (at, size, np.arange(len(at))), len(points)), targets)
                    yield pa.RecordBatch.from_arrays([*kept, pc.if_else(pc.is_valid(rows["__text"]), converted, None)], [*names, "__text"])
                else:
                    row = np.searchsorted(starts, at, side="right") - 1
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows.num_rows))]).astype(np.int32)
                    hits = pa.StructArray.from_arrays([pa.array((at - starts[row]).astype(np.int32)), pa.array(size.astype(np.int32)), targets], fields=list(arrow_hit))
                    yield pa.RecordBatch.from_arrays([*kept, rows["__text"], pa.ListArray.from_arrays(pa.array(offsets), hits)],
                                                     [*names, "__text", "__hits"])

        fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "__text string", *([] if last else [f"__hits {kind}"])]
        found = found.mapInArrow(run, ", ".join(fields))
        if not last:
            found = stored(found, "phrase_hits")
    return found.withColumnRenamed("__text", output).select(*dict.fromkeys([*files.columns, output]))


def _replaced(points: np.ndarray, starts: np.ndarray, path: tuple[np.ndarray, np.ndarray, np.ndarray], targets: pa.Array) -> pa.Array:
    """The texts with the words of the path replaced by their targets."""
    at, size, hit = path
    letters, begins = T.letters_of(targets)
    # Each step writes letters of its target, or its own one.
    source = np.concatenate([points, letters])
    begin = np.where(hit < 0, at, len(points) + begins[hit])
    length = np.where(hit < 0, size, np.diff(begins)[hit] if len(targets) else 1)
    ends = np.cumsum(length)
    out = source[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    stops = np.concatenate([[0], ends])[np.searchsorted(at, starts)]
    text = out.astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([text[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())], pa.string())


def simplify_words(words: DataFrame, dictionary: DataFrame, pairs: DataFrame, word: str = "word",
                   traditional: str = "traditional", simplified: str = "simplified") -> DataFrame:
    """Convert whole words: the dictionary entry when there is one, else character by character."""
    entries = dictionary.groupBy(F.col(traditional).alias(word)).agg(F.min(simplified).alias("__entry"))
    return (words.join(entries, word, "left")
            .withColumn(word, F.coalesce(F.col("__entry"), simplify_text(F.col(word), pairs)))
            .drop("__entry"))


def lowest_level(wordlist: DataFrame, word: str = "word", level: str = "word_level") -> DataFrame:
    """One row per word; entries that fell together keep the lowest level."""
    return wordlist.groupBy(word).agg(F.min(level).alias(level))
