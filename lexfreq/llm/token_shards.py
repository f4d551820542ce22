"""Operator 6, token-ID output in training order.

Every text is encoded with a byte-level BPE and ended with an end-of-text id. The documents of a task are strung together in the order of the
scan and cut into sequences of LENGTH ids, so only the last sequence of a task is shorter. A keyed Feistel permutation of [0, N), N being the
number of sequences, gives every sequence its place in the training order ("slot"): four rounds on the smallest even number of bits that holds
N, walked on while outside [0, N). So the order is random but every slot is taken exactly once, without sorting by a random number.

A shard holds SHARD_SEQUENCES consecutive slots as records of a fixed stride: LENGTH little-endian ids of 16 or 32 bits, a short sequence being
filled up with the end-of-text id, and a line feed. Slot s is record s mod SHARD_SEQUENCES of shard s div SHARD_SEQUENCES, at a byte offset that
follows from s alone, so a reader can begin anywhere. Sequences are dealt out by ranges of shards, each task sorts its slots and
writes whole shards; Spark's committer replaces what a lost task has left.

Encoded sequences are written once, numbered by task and position; the number before the permutation is that position plus
the sequences of the tasks before, so it needs no sort, and lost tasks come back with the same numbers.

Defined cases: a null or empty text is the end-of-text id alone. Repeated rows and doc_ids are strung in once each. Special tokens in
a text are ordinary text. Other columns are ignored. No documents make no sequences.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexfreq.llm.scratch import arrow_map, dropped_shuffles, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LENGTH = 1024
SHARD_SEQUENCES = 8192
ROUNDS = 4
ROUNDS_OF_SHARDS = 2
TASK_SHARDS = 64


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary file's contents."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("supplied", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def id_type(vocabulary: bytes) -> str:
    """Two bytes an id where all ids and the end of text fit, else four."""
    return "<u2" if encoder(vocabulary).n_vocab < 1 << 16 else "<u4"


def permuted(numbers: np.ndarray, n: int, key: bytes, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each number in a keyed permutation of [0, n)."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([r]), key=key, digest_size=8).digest(), "big")) for r in range(rounds)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


class _Strung:
    """Documents of a task, one after the other, cut into sequences of a fixed length."""

    def __init__(self, length: int) -> None:
        self.length, self.filled = length, 0
        self.pieces: list[dict] = []
        self.parts: list[np.ndarray] = []

    def add(self, doc_id: object, tokens: np.ndarray) -> Iterator[tuple[list[dict], bytes]]:
        at = 0
        while at < len(tokens):
            n = min(self.length - self.filled, len(tokens) - at)
            self.pieces.append({"doc_id": doc_id, "begin": at, "n": n})
            self.parts.append(tokens[at:at + n])
            self.filled += n
            at += n
            if self.filled == self.length:
                yield self.take()

    def take(self) -> tuple[list[dict], bytes]:
        out = self.pieces, np.concatenate(self.parts).tobytes()
        self.pieces, self.parts, self.filled = [], [], 0
        return out


def encoded(docs: DataFrame, vocabulary: bytes, length: int = LENGTH) -> DataFrame:
    """pieces (doc_id, begin in its tokens, n), n_tokens and ids of every sequence, with its task and position in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType
    piece = pa.list_(pa.struct([("doc_id", to_arrow_type(kind)), ("begin", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, id_kind = encoder(shared.value), id_type(shared.value)
        task, at, strung = TaskContext.get().partitionId(), 0, _Strung(length)

        def rows(found: list[tuple[list[dict], bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], piece), pa.array([sum(p["n"] for p in f[0]) for f in found], pa.int32()),
                 pa.array([f[1] for f in found], pa.binary()), pa.array(np.full(len(found), task, np.int32)),
                 pa.array(np.arange(at, at + len(found)))], ["pieces", "n_tokens", "ids", "task", "at"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part, found = batch.slice(begin, 512), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    found += strung.add(doc_id, np.array([*own.encode_ordinary(text.as_py() or ""), own.n_vocab], id_kind))
                yield rows(found)
                at += len(found)
        if strung.filled:
            yield rows([strung.take()])

    fields = f"pieces array<struct<doc_id:{kind.simpleString()},begin:int,n:int>>, n_tokens int, ids binary, task int, at bigint"
    return arrow_map(docs.select("doc_id", "text"), run, fields)


def ordered(docs: DataFrame, key: bytes = b"training order", vocabulary_path: str = VOCABULARY, length: int = LENGTH,
            shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """slot, shard, record, pieces, n_tokens and ids of every sequence."""
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        vocabulary = file.read()
    # Ids have few repeats but an uneven distribution, which only an entropy coder makes use of.
    sequences = written(encoded(docs, vocabulary, length), "sequences", "zstd")
    # One row for each task of the scan.
    counts = sorted((r["task"], r["count"]) for r in sequences.groupBy("task").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int).tolist()
    offsets = written(spark.createDataFrame([(t, b) for (t, _), b in zip(counts, before)], "task int, before bigint"), "task_offsets")
    n = before[-1]

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, key))

    placed = sequences.join(offsets, "task").withColumn("slot", place(F.col("before") + F.col("at")))
    return placed.select("slot", F.floor(F.col("slot") / shard_sequences).cast("bigint").alias("shard"),
                         (F.col("slot") % shard_sequences).cast("int").alias("record"), "pieces", "n_tokens", "ids")


def payload(length: int, vocabulary: bytes) -> Column:
    """The record of a sequence without its line feed: its ids, filled up to the fixed length."""
    kind = id_type(vocabulary)
    filler = np.full(length, encoder(vocabulary).n_vocab, kind).tobytes()
    return F.substring(F.concat(F.col("ids"), F.lit(bytearray(filler))), 1, len(filler))


def write_shards(sequences: DataFrame, folder: str, vocabulary_path: str = VOCABULARY, length: int = LENGTH,
                 rounds: int = ROUNDS_OF_SHARDS) -> None:
    """One file below folder/shard=<number> for every shard: its records in slot order.

    Shards are dealt to tasks by ranges of their numbers, up to TASK_SHARDS each. They are written in rounds, each of which
    shuffles its part of the sequences, so no more than that part is on disk besides the sequences and the shards.
    """
    spark = sequences.sparkSession
    with open(vocabulary_path, "rb") as file:
        record = payload(length, file.read())
    shards = (sequences.agg(F.max("shard")).first()[0] or 0) + 1
    per_round = -(-shards // rounds)
    tasks = max(1, min(per_round, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-per_round // TASK_SHARDS))))
    per_task = -(-per_round // tasks)
    with dropped_shuffles(spark):
        for number in range(rounds):
            first = number * per_round
            own = sequences.filter((F.col("shard") >= first) & (F.col("shard") < first + per_round)).select("shard", "slot", "ids")
            dealt = own.repartitionById(tasks, F.floor((F.col("shard") - first) / per_task).cast("int")).sortWithinPartitions("shard", "slot")
            (dealt.select("shard", record.cast("string").alias("value")).write.partitionBy("shard")
             .mode("append" if number else "overwrite").option("lineSep", "\n").text(folder))


def stride(vocabulary_path: str = VOCABULARY, length: int = LENGTH) -> int:
    """Bytes from one record to the next."""
    with open(vocabulary_path, "rb") as file:
        return length * int(id_type(file.read())[-1]) + 1


def read_record(data: bytes, record: int, n_tokens: int, vocabulary_path: str = VOCABULARY, length: int = LENGTH) -> np.ndarray:
    """The ids of a record of a shard's bytes, without what fills it up."""
    with open(vocabulary_path, "rb") as file:
        kind = id_type(file.read())
    step = stride(vocabulary_path, length)
    return np.frombuffer(data[record * step:(record + 1) * step - 1], kind)[:n_tokens]
