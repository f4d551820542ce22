from pathlib import Path

import numpy as np
import pytest

from lexfreq.llm import token_shards as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary file")
SCHEMA = "doc_id bigint, text string, slot int, ids string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    places = T.permuted(np.arange(n), n, b"key")
    assert sorted(places.tolist()) == list(range(n))
    if n >= 64:
        assert places.tolist() != list(range(n)) and places.tolist() != T.permuted(np.arange(n), n, b"other").tolist()


def test_shards_give_the_texts_back(spark, tmp_path):
    texts = [f"Text number {i}: " + "größer als 日本 <|endoftext|>\r\n" * (i % 40) for i in range(300)] + [None, "", "x" * 5000]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(7, texts[7], 0, "x"), (None, "no id", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sequences = T.ordered(docs, length=32, shard_sequences=64)
    T.write_shards(sequences, str(tmp_path / "out"), length=32)
    index = sequences.collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n))
    with open(T.VOCABULARY, "rb") as file:
        own = T.encoder(file.read())
    shards = {}
    for path in (tmp_path / "out").glob("shard=*/part-*"):
        number = int(path.parent.name.split("=")[1])
        assert number not in shards
        shards[number] = path.read_bytes()
    assert sum(map(len, shards.values())) == n * T.stride(length=32)
    pieces = {}
    for r in index:
        assert (r.shard, r.record) == divmod(r.slot, 64)
        record = T.read_record(shards[r.shard], r.record, r.n_tokens, length=32)
        assert record.tobytes() == bytes(r.ids) and len(record) == r.n_tokens == sum(p.n for p in r.pieces)
        at = 0
        for p in r.pieces:
            pieces.setdefault(p.doc_id, []).append((p.begin, record[at:at + p.n]))
            at += p.n
    assert sum(r.n_tokens < 32 for r in index) <= 5
    for i, text in enumerate(texts):
        if i != 7:
            whole = np.concatenate([x for _, x in sorted(pieces[i], key=lambda p: p[0])])
            assert whole[-1] == own.n_vocab and own.decode(whole[:-1].tolist()) == (text or "")
    assert sum(len(x) for _, x in pieces[7]) == 2 * (len(own.encode_ordinary(texts[7])) + 1)
    assert own.decode(np.concatenate([x for _, x in sorted(pieces[None], key=lambda p: p[0])])[:-1].tolist()) == "no id"


def test_the_same_order_every_time(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", 0, "x") for i in range(100)], SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    one, two = ({tuple((p.doc_id, p.begin) for p in r.pieces): r.slot for r in T.ordered(docs, length=8).collect()} for _ in range(2))
    assert one == two != {tuple((p.doc_id, p.begin) for p in r.pieces): r.slot for r in T.ordered(docs, key=b"another", length=8).collect()}


def test_no_documents(spark, tmp_path):
    none = T.ordered(spark.createDataFrame([], SCHEMA))
    assert none.collect() == []
    T.write_shards(none, str(tmp_path / "empty"))
