"""Chunking, tokenisation and hashing."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from opsdesk.functions.embed import blake2b_bucket_sign, hashed_vectors
from opsdesk.functions.text import token_bucket, token_sign, tokenize
from opsdesk.operators import retrieve as R


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (730, 1), (731, 2), (850, 2), (1000, 2), (1461, 3)])
def test_chunk_counts(spark, n, expected):
    df = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert R.chunk_documents(df).count() == expected


def test_chunks_rebuild_normalised_text(views):
    docs = views.knowledge.select("doc_id", "text")
    chunks = R.chunk_documents(docs).collect()
    by_doc = {}
    for r in chunks:
        by_doc.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    for doc_id, parts in by_doc.items():
        parts.sort()
        rebuilt = parts[0][1] + "".join(p[1][120:] for p in parts[1:])
        assert rebuilt == texts[doc_id]


def test_md5_hash_goldens(spark):
    df = spark.createDataFrame([("refund",), ("₹999",), ("password",)], "t string")
    got = [(r.b, r.s) for r in df.select(token_bucket(F.col("t")).alias("b"), token_sign(F.col("t")).alias("s"))
           .collect()]
    assert got == [(104, -1), (178, -1), (59, -1)]


def test_blake2b_goldens():
    assert blake2b_bucket_sign("refund") == (114, -1)
    assert blake2b_bucket_sign("₹999") == (24, -1)
    assert blake2b_bucket_sign("password") == (163, 1)
    v = hashed_vectors(["refund refund password"])[0]
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_tokenize_matches_python_unicode_words(views):
    docs = views.table("documents").select("doc_id", "text", tokenize(F.col("text")).alias("t")).collect()
    pat = regex.compile(r"[\w₹]+")
    for r in docs:
        assert r.t == pat.findall(r.text.lower())


def test_sparse_hash_matches_python(spark):
    df = spark.createDataFrame([(1, "Refund the refund, please! ₹999 password")], "doc_id long, content string")
    got = {(r.bucket, r.v) for r in R.hash_embed(df, ["doc_id"]).collect()}
    exp = {}
    for tok in regex.findall(r"[\p{L}\p{N}_₹]+", "refund the refund, please! ₹999 password"):
        h = hashlib.md5(tok.encode()).hexdigest()
        b, s = int(h[:8], 16) % 256, (1 if int(h[8:10], 16) % 2 else -1)
        exp[b] = exp.get(b, 0) + s
    assert got == {(b, v) for b, v in exp.items() if v != 0}


def test_batch_embedder_udf_equals_python_vectors(spark):
    from opsdesk.functions.embed import embed_column
    texts = ["Refund the ₹999 charge", "password reset link", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", embed_column(F.col("t")).alias("e")).collect()}
    exp = hashed_vectors(texts)
    for i in range(len(texts)):
        assert len(got[i]) == 256
        assert max(abs(a - b) for a, b in zip(got[i], exp[i])) < 1e-7


def test_unicode_white_space_collapses(spark):
    from opsdesk.functions.text import is_blank, normalize_ws, py_strip
    raw = "  a　 b\t\u0085c  "
    r = spark.createDataFrame([(raw, "　 ")], "t string, e string").select(
        normalize_ws("t").alias("n"), py_strip("t").alias("s"), is_blank("e").alias("b")).first()
    assert r.n == " ".join(raw.split()) and r.s == raw.strip() and r.b


def test_hash_embed_parts_grow_with_the_text(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 10) for i in range(50)], "doc_id long, text string")
    rows = R.chunk_documents(docs)
    parts = [R.by_volume(rows, ["doc_id", "chunk_index"], d, task_chars=1000).rdd.getNumPartitions() for d in (docs.limit(0), docs.limit(10), docs)]
    assert parts == [1, 3, 11]


def test_vector_statistics_stay_in_the_embedding_pass(spark):
    from opsdesk.functions.embed import counted_embedder, counted_vectors, embed_column, vector_stats
    texts = ["Refund the ₹999 charge the", "password reset link", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vector_stats(embed_column(F.col("t"), counted_embedder)).alias("s"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.i: tuple(r.s) for r in df.collect()}
    for i, v in enumerate(counted_vectors(texts)):
        assert got[i] == (256, sum(x != 0 for x in v), sum(x * x for x in v), sum(j * x for j, x in enumerate(v)))
