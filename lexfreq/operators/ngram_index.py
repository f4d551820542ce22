"""A stored index of sentences by their character trigrams, for literal substring search.

Sentences are dealt by their hash into blocks of BLOCK at most and numbered in them. A posting is a trigram, a block and the sorted
numbers of the sentences of the block that hold it, as gaps of two bytes. So no list is longer than a block, however frequent
its trigram. Postings are sorted by trigram, with a Bloom filter, and sentences lie in a folder for each block, in small row groups.

A search of three characters or more reads the postings of its trigrams, intersects them block by block, reads the sentences that are left and
keeps those that hold the query. Shorter ones have no trigram: all sentences are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexfreq.operators.trie import distinct, letters_of
from lexfreq.session import ship_package

BLOCK = 1 << 16
# Sentences that a search asks for by number; beyond that it joins the numbers.
ASKED = 4096
GROUP_BYTES = 1 << 20
# Sentences in a page, which is what a look-up by number reads.
PAGE_ROWS = 50
# Sentences whose trigrams are found together.
SLICE = 1 << 11
_FILE = "array<struct<exam_id:string,source_type:string>>"


def trigrams(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram and text of every place where three characters follow in one text. A trigram is a number of three times 21 bits."""
    n = len(points) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (points[:n] << 42) | (points[1:n + 1] << 21) | points[2:]
    text = np.searchsorted(starts, np.arange(n), side="right") - 1
    inside = np.arange(n) + 3 <= starts[text + 1]
    return grams[inside], text[inside]


def query_trigrams(query: str) -> list[int]:
    grams, _ = trigrams(*letters_of(pa.array([query])))
    return sorted(set(grams.tolist()))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            # A hash may deal some blocks more than their share; the rest makes blocks of its own.
            part = batch.slice(begin, BLOCK)
            place = np.arange(at, at + part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array((block + ((place // BLOCK) << 32)).astype(np.int64)), pa.array((place % BLOCK).astype(np.int32)),
                 *[part[c] for c in ("sentence", "files")]], ["block", "place", "sentence", "files"])


def _lists(block: int, grams: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The postings of a block, from its trigrams and the places of their sentences; the lists are used up."""
    known = distinct(np.concatenate([distinct(own) for own in grams])) if grams else np.zeros(0, np.int64)
    # One number for trigram and place, sorted where it is: two columns and their order would take several times its memory.
    keys, filled = np.empty(sum(map(len, grams)), np.int64), 0
    while grams:
        gram, place = grams.pop(), places.pop()
        keys[filled:filled + len(gram)] = np.searchsorted(known, gram) << 16 | place
        filled += len(gram)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    first = np.searchsorted(keys, np.arange(len(known)) << 16)
    place = keys.astype("<u2")
    del keys, new
    gaps = np.diff(place, prepend=place[:1])
    gaps[first] = place[first]
    data = gaps.tobytes()
    offsets = np.append(first, len(gaps)) * 2
    for at in range(0, len(first), 1 << 14):
        own = offsets[at:at + (1 << 14) + 1]
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer((own - own[0]).astype(np.int32)),
                                                                        pa.py_buffer(data[own[0]:own[-1]])])
        yield pa.RecordBatch.from_arrays([pa.array(known[at:at + len(own) - 1]), pa.array(np.full(len(own) - 1, block)), lists],
                                         ["gram", "block", "gaps"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: list[np.ndarray] = []
    places: list[np.ndarray] = []
    block = None
    for batch in batches:
        blocks = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            if block is not None and blocks[begin] != block:
                yield from _lists(block, grams, places)
            block = int(blocks[begin])
            for at in range(begin, end, SLICE):
                part = batch.slice(at, min(SLICE, end - at))
                gram, text = trigrams(*letters_of(part["sentence"]))
                grams.append(gram)
                places.append(part["place"].to_numpy()[text].astype(np.uint16))
    if block is not None:
        yield from _lists(block, grams, places)


def write_index(sentences: DataFrame, folder: str) -> None:
    """Write the index of sentences(exam_id, source_type, sentence): folder/texts and folder/postings."""
    spark = sentences.sparkSession
    ship_package(spark)
    # Behind the boilerplate filter a sentence has few files.
    listed = sentences.groupBy("sentence").agg(F.array_sort(F.collect_set(F.struct("exam_id", "source_type"))).alias("files"))
    count = sentences.select(F.approx_count_distinct("sentence").alias("n")).first().n
    blocks = max(1, -(-count * 5 // (4 * BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions")) if count > BLOCK else 1)
    texts = listed.repartition(blocks, "sentence").mapInArrow(_numbered, f"block bigint, place int, sentence string, files {_FILE}")
    (texts.write.partitionBy("block").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .parquet(f"{folder}/texts"))
    stored = read_texts(spark, folder).select("block", "place", "sentence")
    rows = stored.mapInArrow(_postings, "gram bigint, block bigint, gaps binary")
    # A trigram that is everywhere has a row per block, so its rows are dealt out by those too.
    (rows.repartition("gram", F.floor(F.col("block") / 1024)).sortWithinPartitions("gram", "block")
     .write.option("parquet.bloom.filter.enabled#gram", "true").option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/postings"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"place INT, sentence STRING, files {_FILE}, block BIGINT").parquet(f"{folder}/texts")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """block and place of the sentences that hold all trigrams of the query."""
    ship_package(spark)
    grams = query_trigrams(query)
    rows = spark.read.schema("gram BIGINT, block BIGINT, gaps BINARY").parquet(f"{folder}/postings").filter(F.col("gram").isin(grams))
    # At most a block's numbers for each trigram of the query, or twice that where a block was read by two tasks.
    lists = rows.groupBy("block").agg(F.collect_list(F.struct("gram", "gaps")).alias("lists"), F.count_distinct("gram").alias("n"))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch["block"].to_pylist(), batch["lists"].to_pylist()):
                by: dict[int, list[np.ndarray]] = {}
                for row in own:
                    by.setdefault(row["gram"], []).append(np.cumsum(np.frombuffer(row["gaps"], "<u2").astype(np.int64)))
                left: np.ndarray | None = None
                for places in sorted((np.concatenate(p) for p in by.values()), key=len):
                    left = places if left is None else left[np.isin(left, places)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), block)), pa.array(left.astype(np.int32))], ["block", "place"])

    return lists.filter(F.col("n") == len(grams)).select("block", "lists").mapInArrow(intersect, "block bigint, place int")


def search(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """exam_id, source_type and sentence of all sentences that hold the query."""
    texts = read_texts(spark, folder)
    if len(query) >= 3:
        found = candidates(spark, folder, query)
        asked = found.limit(ASKED + 1).collect()
        if len(asked) <= ASKED:
            by: dict[int, list[int]] = {}
            for r in asked:
                by.setdefault(r.block, []).append(r.place)
            places = F.lit(False)
            for block, own in sorted(by.items()):
                places = places | ((F.col("block") == block) & F.col("place").isin(sorted(own)))
            # The numbers as such, too: in a disjunction over blocks they would not reach the row groups.
            texts = texts.filter(F.col("block").isin(sorted(by)) & F.col("place").isin(sorted({r.place for r in asked})) & places)
        else:
            texts = texts.join(found, ["block", "place"], "left_semi")
    hits = texts.filter(F.contains(F.col("sentence"), F.lit(query)))
    return hits.select(F.explode("files").alias("file"), "sentence").select("file.exam_id", "file.source_type", "sentence")
