"""The stored vector index and exact top-k retrieval."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import retrieve as R
from opsdesk.operators import vectors as V
from opsdesk.operators.index import NO_TEXT, NOT_FOUND, VectorIndex
from opsdesk.session import scratch_path

import hashlib
import random
import uuid

DOC = "doc_id long, filename string, document_type string, text string"


def doc(i, text):
    return (i, f"f{i}.txt", "guide", text)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"word{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture()
def index(spark):
    return VectorIndex.create(spark, scratch_path(spark, f"test-index-{uuid.uuid4().hex}"))


def vector(text):
    v = np.zeros(LX.HASH_DIMS, np.int64)
    for t in re.findall(r"[\w₹]+", text.lower()):
        d = hashlib.md5(t.encode()).digest()
        v[int.from_bytes(d[:4], "big") % LX.HASH_DIMS] += 1 if d[4] & 1 else -1
    return v


def chunks_of(rows):
    out = []
    for i, _, _, text in rows:
        t = re.sub(r"\s+", " ", text or "").strip()
        out += [(i, n, t[a:a + LX.CHUNK_SIZE]) for n, a in enumerate(range(0, len(t), LX.CHUNK_SIZE - LX.CHUNK_OVERLAP))]
    return out


def brute(rows, queries, k):
    """{qid: [(doc_id, chunk_index, score), ...]}."""
    chunks = [(i, n, vector(c)) for i, n, c in chunks_of(rows)]
    out = {}
    for qid, text in queries:
        if text and text.strip():
            q = vector(text)
            best = sorted((-(int(q @ v) / np.sqrt(float(int(q @ q) * int(v @ v))) if (q @ q) * (v @ v) else 0.0), i, n) for i, n, v in chunks)
            out[qid] = [(i, n, np.floor(max(0.0, -s) * 1000 + 0.5) / 1000) for s, i, n in best[:k]]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.qid), r.rank)):
        out.setdefault(r.qid, []).append((r.doc_id, r.chunk_index, r.score))
    return out


ROWS = [doc(i, prose(i, 40 * (i % 9) + 5)) for i in range(60)] + [doc(60, "!!! ???"), doc(61, "  \n "), doc(62, None), doc(63, prose(3, 125))]
QUERIES = [(q, prose(q, 12)) for q in range(40)] + [(40, "?!"), (41, "  "), (42, None), (43, "nothing like it anywhere"), (44, prose(3, 125))]


def make(spark, rows):
    return spark.createDataFrame(rows, DOC)


def ask(spark):
    return spark.createDataFrame(QUERIES, "qid long, text string")


@pytest.mark.parametrize("slab_bytes", [V.SLAB_BYTES, 7 * 8 * LX.HASH_DIMS])
def test_retrieval_equals_brute_force_with_one_and_several_query_slabs(spark, index, slab_bytes, monkeypatch):
    index.add(make(spark, ROWS), "2024-01-01 00:00:00")
    assert hits(index.retrieve(ask(spark), 5, slab_bytes=slab_bytes)) == brute(ROWS, QUERIES, 5)


def test_always_k_hits_or_all_chunks(spark, index):
    index.add(make(spark, ROWS[:4]), "2024-01-01 00:00:00")
    got = hits(index.retrieve(ask(spark), 50))
    n = len(chunks_of(ROWS[:4]))
    assert set(got) == {q for q, t in QUERIES if t and t.strip()} and all(len(h) == n for h in got.values())


def test_unstored_chunks_give_the_same_hits(spark):
    docs = make(spark, ROWS)
    chunks = R.chunk_documents(docs)
    got = R.retrieve_cosine(ask(spark), chunks, R.chunk_documents(docs, keep=["filename", "document_type"]), 4)
    assert hits(got) == brute(ROWS, QUERIES, 4)
    pairs = R.cosine_pairs(R.hash_embed(ask(spark).where("qid < 10"), ["qid"], "text"), ["qid"], R.hash_embed(chunks, ["doc_id", "chunk_index"]),
                           ["doc_id", "chunk_index"], query_broadcast=False, salts=8)
    joined = R.top_k(pairs, ["qid"], [F.col("cosine").desc(), F.col("doc_id"), F.col("chunk_index")], 1)
    got = hits(got)
    assert all((r.doc_id, r.chunk_index) == got[r.qid][0][:2] for r in joined.collect())


def test_two_successive_runs_embed_only_what_is_missing(spark, index):
    first, all_docs = make(spark, ROWS[:30]), make(spark, ROWS)
    assert index.sync(first, "2024-01-01 00:00:00") == 1
    missing = index.missing(all_docs)
    assert sorted(r.doc_id for r in missing.collect()) == [r[0] for r in ROWS[30:]]
    assert index.sync(all_docs, "2024-01-02 00:00:00") == 2
    written = index._read("chunks", "doc_id long, commit string").groupBy("commit").agg(F.collect_set("doc_id").alias("d")).collect()
    assert sorted(sorted(r.d) for r in written) == sorted(
        sorted({i for i, _, _ in chunks_of(part)}) for part in (ROWS[:30], ROWS[30:]))
    assert index.missing(all_docs).count() == 0
    state = {r.doc_id: r for r in index.documents().collect()}
    assert len(state) == len(ROWS) and state[61].status == state[62].status == "Rejected" and state[61].error == NO_TEXT
    assert state[1].indexed_at.day == 1 and state[31].indexed_at.day == 2
    assert hits(index.retrieve(ask(spark), 5)) == brute(ROWS, QUERIES, 5)
    assert hits(index.at(1).retrieve(ask(spark), 5)) == brute(ROWS[:30], QUERIES, 5)


def test_chunking_comes_after_the_anti_join(spark, index):
    index.add(make(spark, ROWS[:30]), "2024-01-01 00:00:00")
    plan = V.chunk_stats(R.chunk_documents(index.missing(make(spark, ROWS))))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftAnti")      # the plan is printed from its result down


def test_reindex_replaces_and_delete_removes(spark, index):
    index.add(make(spark, ROWS), "2024-01-01 00:00:00")
    changed = [doc(5, "entirely new words here"), doc(7, " "), doc(999, "not in the index")]
    assert [tuple(r) for r in index.unknown(make(spark, changed)).collect()] == [(999, NOT_FOUND)]
    seq = index.reindex(make(spark, changed), "2024-02-02 00:00:00")
    now = [changed[0] if r[0] == 5 else r for r in ROWS if r[0] != 7]
    assert hits(index.retrieve(ask(spark), 6)) == brute(now, QUERIES, 6)
    assert hits(index.at(seq - 1).retrieve(ask(spark), 6)) == brute(ROWS, QUERIES, 6)
    state = {r.doc_id: r for r in index.documents().collect()}
    assert state[5].indexed_at.month == 2 and state[6].indexed_at.month == 1 and state[7].status == "Rejected" and 999 not in state
    index.delete(spark.createDataFrame([(5,), (8,), (12345,)], "doc_id long"))
    left = [r for r in now if r[0] not in (5, 8)]
    assert hits(index.retrieve(ask(spark), 6)) == brute(left, QUERIES, 6)
    assert {(r.doc_id, r.chunk_index) for r in index.chunks().collect()} == {(i, n) for i, n, _ in chunks_of(left)}
    assert {(r.doc_id, r.chunk_index) for r in index.vector_stats().collect()} == {(i, n) for i, n, _ in chunks_of(left)}
    index.sync(make(spark, ROWS), "2024-03-03 00:00:00")         # deleted documents are missing again
    assert hits(index.retrieve(ask(spark), 6)) == brute([r if r[0] in (5, 8) else n for r, n in zip(ROWS, ROWS)
                                                         if r[0] != 7], QUERIES, 6)


def test_rows_of_a_commit_that_never_reached_the_log_are_invisible(spark, index, monkeypatch):
    index.add(make(spark, ROWS[:20]), "2024-01-01 00:00:00")
    before = hits(index.retrieve(ask(spark), 5))
    monkeypatch.setattr(VectorIndex, "_log", lambda self, rows, seq: None)
    index.add(make(spark, ROWS[20:40]), "2024-01-02 00:00:00")
    assert hits(index.retrieve(ask(spark), 5)) == before and index.last_seq() == 1
    monkeypatch.undo()
    index.add(make(spark, ROWS[20:40]), "2024-01-02 00:00:00")
    assert hits(index.retrieve(ask(spark), 5)) == brute(ROWS[:40], QUERIES, 5)


def test_an_empty_index_and_no_queries(spark, index):
    assert index.retrieve(ask(spark), 3).count() == 0 and index.documents().count() == 0 and index.last_seq() == 0
    index.add(make(spark, ROWS[:5]), "2024-01-01 00:00:00")
    assert index.retrieve(ask(spark).where("qid < 0"), 3).count() == 0


def test_bounds_skip_blocks_of_other_topics(spark, index):
    topics = [doc(100 * t + i, " ".join([f"topic{t}"] * 20 + [f"t{t}w{random.Random(i).randrange(30)}" for _ in range(30)]))
              for t in range(6) for i in range(100)]
    index.add(make(spark, topics), "2024-01-01 00:00:00")
    q = spark.createDataFrame([(t, f"topic{t} topic{t} topic{t} t{t}w3") for t in range(6)], "qid long, text string")
    assert hits(index.retrieve(q, 5)) == brute(topics, [(r.qid, r.text) for r in q.collect()], 5)
    r = index.skipped(q, 5).first()
    assert r.pairs > 0 and 0 <= r.skipped <= r.pairs


def test_bound_is_never_below_a_score():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    toks = [[f"w{x}" for x in rng.integers(0, 300, rng.integers(0, 60))] for _ in range(700)]
    table = pa.table({"doc_id": pa.array(range(700), pa.int64()), "chunk_index": pa.array([0] * 700, pa.int32()),
                      "toks": pa.array(toks, pa.list_(pa.string())), "commit": ["c"] * 700, "grp": pa.array([0] * 700, pa.int64())})
    packed = V.pack_blocks(table)
    batch = packed.append_column("dead", pa.nulls(packed.num_rows, pa.list_(pa.int64()))).combine_chunks().to_batches()[0]
    q = V.hashed_rows(pa.array(toks[:50], pa.list_(pa.string()))).astype(float)
    q /= np.maximum(1e-300, np.sqrt((q * q).sum(1)))[:, None]
    seen = 0
    for b in range(batch.num_rows):
        block = V._Block(batch, b)
        high, low = (np.frombuffer(batch.column(c)[b].as_py()) for c in ("high", "low"))
        unit = block.dense / np.sqrt(np.maximum(1, block.norm2))[:, None]
        assert ((q @ unit.T).max(1) <= np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + V.SLACK).all()
        seen += len(block.doc)
    assert seen == 700


def test_best_keeps_the_best_with_ties():
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 6, (9, 400)).astype(float)
    scores[3] = np.nan
    best = V.Best(9, 7, 1)
    ids = rng.permutation(400)
    for at in range(0, 400, 33):
        best.add(np.arange(9), scores[:, at:at + 33], ids[at:at + 33])
    best.cut()
    for q in range(9):
        want = sorted((-s, i) for s, i in zip(scores[q], ids) if not np.isnan(s))[:7]
        at = best.kept[0] == q
        assert list(zip((-best.kept[1][at]).tolist(), best.kept[2][at].tolist())) == want


def test_a_commit_writes_one_file_per_bucket_folder(spark):
    from pathlib import Path
    docs = spark.createDataFrame([doc(i, prose(i, 40)) for i in range(400)], DOC).repartition(8)
    index = VectorIndex.create(spark, scratch_path(spark, f"test-index-{uuid.uuid4().hex}"))
    index.add(docs, "2024-01-01 00:00:00")
    folders = [[f for f in d.iterdir() if f.name.endswith(".parquet")] for d in Path(index.path, "chunks").glob("bucket=*")]
    assert len(folders) > 100 and {len(files) for files in folders} == {1}
    assert index.chunks().select("doc_id").distinct().count() == 400


def test_tokens_travel_as_one_string(spark):
    import pyarrow as pa
    assert V.split_tokens(pa.array(["a b a", "", None, "x"])).to_pylist() == [["a", "b", "a"], None, None, ["x"]]
    rows = spark.createDataFrame([("c", 0, 1, 0, "two words two"), ("c", 0, 2, 0, " ?! ")], "commit string, grp long, doc_id long, chunk_index int, content string")
    packed = V.blocks_of(rows).first()
    assert np.frombuffer(packed.norm2, np.int64).sum() in (5, 1, 9)       # no token, no entry
    assert sorted(np.diff(np.frombuffer(packed.first, np.int32)).tolist())[0] == 0
