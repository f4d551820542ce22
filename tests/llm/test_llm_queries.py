"""The registered queries on the smallest supplied tables, and the pipeline stage by stage."""

from pathlib import Path

import numpy as np
import oracle
import pytest
import test_llm_decontaminate
import test_llm_simhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexfreq.llm import mixing, queries, token_shards
from lexfreq.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no supplied tables")
COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken", "op2_nearest_vectors": "query_id rank vec_id score",
    "op3_simhash_near_duplicates": "doc_id fingerprint component_id", "op5_quality": "doc_id held_out score predicted",
    "op7_toxicity": "doc_id held_out score predicted", "op8_main_text": "page_id url text n_chars",
    "op9_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_substring_dedup": "doc_id n_words n_removed kept_sha256", "op12_ranked_search": "item_id rank doc_id score",
    "op13_spelling_variants": "word form root n n_near form_n",
}


def test_operators_are_registered():
    assert {int(name.split("_")[0][2:]) for name in queries.QUERIES} == {*range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns[:len(COLUMNS.get(name, "").split())] == COLUMNS.get(name, "").split()
    if name in queries.ORACLES:
        assert oracle.differences(df, oracle.connect(FOLDER), queries.ORACLES[name]) == []
    else:
        table = {"op2": 1, "op8": "pages", "op13": 1}.get(name.split("_")[0], "documents")
        rows = df.count()
        assert rows > 0 if table == 1 or name.startswith("op6") else rows == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_nearest_vectors_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in queries.QUERIES["op2_nearest_vectors"](spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((data - data[ids == q][0])**2).sum(axis=1))
        hits += len(found[q] & set([i for i in ids[np.lexsort((ids, far))] if i != q][:10]))
    assert hits >= 0.9 * 10 * len(found) and len(found) == (ids % 100 == 0).sum()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what the last returns; each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], FOLDER).write.parquet(str(folder / name))
        docs.append(spark.read.parquet(str(folder / name)))
    return docs


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxic_documents_go(spark, stages):
    scored = queries.QUERIES["op7_toxicity"](spark, FOLDER).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scored if r.score < 0.7}


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: test_llm_simhash.shingles(r.text) for r in stages[1].collect()}
    ids, kept = sorted(sets), {r.doc_id for r in stages[2].collect()}
    like = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for i, a in enumerate(ids) for b in ids[:i]}
    assert any(j >= 0.85 for j in like.values()) and not any(j >= 0.85 and {*pair} <= kept for pair, j in like.items())
    root = test_llm_simhash.reachable([p for p, j in like.items() if j >= 0.8], ids)
    assert set(root.values()) <= kept


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = test_llm_decontaminate.by_definition([(r.doc_id, r.text) for r in stages[2].collect()], items)
    assert {r.doc_id for r in stages[3].collect()} == {d for d, _, hit, _ in found if not hit}


def test_sources_come_near_their_targets(stages):
    words = F.regexp_count("text", F.lit(mixing.WORD))
    before = {r.source: r.n for r in stages[3].groupBy("source").agg(F.sum(words).alias("n")).collect()}
    after = {r.source: r.n for r in stages[4].groupBy("source").agg(F.sum(words).alias("n")).collect()}
    names = sorted(before)
    goal = mixing.targets([before[n] for n in names], [1 + i % 3 for i in range(len(names))])
    assert [after[n] for n in names] == pytest.approx(goal, rel=0.02)
    whole = {(r.doc_id, r.text) for r in stages[3].collect()}
    kept = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert (r.doc_id, r.text) in whole or set(r.text.split()) <= set(kept[r.doc_id].split()) and r.n_chars == len(r.text)


def test_sequences_give_the_texts_back(stages):
    with open(token_shards.VOCABULARY, "rb") as file:
        own = token_shards.encoder(file.read())
    rows = stages[5].collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = {}
    for r in rows:
        tokens, at = np.frombuffer(bytes(r.ids), "<u2"), 0
        for p in r.pieces:
            ids.setdefault(p.doc_id, []).append(tokens[at:at + p.n])
            at += p.n
    texts = {}
    for r in stages[4].collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert ids.keys() == texts.keys()
    for i, parts in ids.items():
        assert sum(map(len, parts)) == sum(len(own.encode_ordinary(t)) + 1 for t in texts[i])


def test_run_is_the_stages_in_turn(spark, stages):
    total = F.sum("n_tokens").alias("n")
    assert corpus_pipeline.run(spark, FOLDER).agg(total).first() == stages[5].agg(total).first()


def test_stages_take_odd_documents(spark):
    """Nulls in every column, empty, long and repeated texts, extra columns with names the operators use, and no rows at all."""
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(1, "some words of a text that is like no other one here", "en", "a", 3), (1, "some words of a text that is like no other one here", "en", "a", 3),
            (2, None, None, None, None), (None, None, None, None, None), (None, "a text without a number", "en", None, 7), (3, "", "de", "b", 0),
            (4, long, "en", "b", len(long)), (5, "\n\n \t", None, "b", 4), (6, "ein anderer Text, der hier sonst nicht vorkommt", "de", None, None)]
    extra = [(*r, 0.5, "x", [1], 9, None) for r in rows]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, size array<int>, "
              "number int, row string")
    docs = spark.createDataFrame(extra, schema)
    for frame in (docs, docs.limit(0)):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, FOLDER)
            rows_out = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                out = spark.createDataFrame(rows_out, docs.schema)
        assert bool(rows_out) == (frame is docs)


def test_rows_with_null_or_repeated_doc_ids_are_told_apart(spark):
    """What becomes of a row says nothing of other rows with the same doc_id or none; of copies one stays, whatever their doc_ids."""
    scored = queries.QUERIES["op7_toxicity"](spark, FOLDER).filter("predicted = 1").select("doc_id")
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = documents.join(scored, "doc_id").orderBy("doc_id").first().text
    leak = max((r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=len)
    clean = ["a text of a few words that has nothing wrong with it, number one of all", "and there is one more of this kind that can stay as it is"]
    copy = "this one comes more than once and one of its copies is to stay in the corpus"
    stages = dict(corpus_pipeline.STAGES)
    for doc_id in (None, 10**9):
        for name, bad in (("toxicity", toxic), ("decontamination", leak)):
            own = [(doc_id, bad), (doc_id, clean[0]), (doc_id, clean[1])]
            frame = documents.select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id bigint, text string"))
            kept = [(r.doc_id, r.text) for r in stages[name](spark, frame, FOLDER).collect()]
            assert own[0] not in kept and own[1] in kept and own[2] in kept
        own = [(doc_id, copy), (doc_id, copy), (doc_id, copy + " too"), (doc_id, clean[0]), (3, clean[1]), (doc_id, clean[1])]
        kept = stages["near_duplicates"](spark, spark.createDataFrame(own, "doc_id bigint, text string"), FOLDER).collect()
        assert sorted(r.text for r in kept if r.text.startswith("this")) in ([copy], [copy + " too"])
        assert [(r.doc_id, r.text) for r in kept if not r.text.startswith("this")].count((doc_id, clean[0])) == 1
        assert [r.doc_id for r in kept if r.text == clean[1]] == [3]


def test_scratch_of_a_stage_goes_with_the_next(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 20, "a") for i in range(40)], "doc_id bigint, text string, source string")

    def folders():
        return {f.name.split("-")[0] for f in Path(scratch_path(spark, "x")).parent.iterdir()}

    stages = dict(corpus_pipeline.STAGES)
    stages["near_duplicates"](spark, docs, FOLDER).collect()
    assert "near_duplicates" in folders()
    stages["decontamination"](spark, docs, FOLDER).collect()
    assert "near_duplicates" not in folders() and "decontamination" in folders()


def test_last_stage_writes_the_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARDS", "spark.lexfreq.test.shards")
    spark.conf.set("spark.lexfreq.test.shards", str(tmp_path / "shards"))
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 200) for i in range(40)], "doc_id bigint, text string")
    rows = corpus_pipeline.token_stage(spark, docs, FOLDER).collect()
    files = {f.parent.name: f.read_bytes() for f in (tmp_path / "shards").glob("shard=*/part-*")}
    assert files and len(rows) > 10
    for r in rows:
        assert token_shards.read_record(files[f"shard={r.shard}"], r.record, r.n_tokens).tobytes() == bytes(r.ids)
