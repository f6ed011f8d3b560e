"""The scale fallbacks give the same answers as the simple paths."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsdesk.operators import retrieve as R
from opsdesk.operators.queue import running_number
from opsdesk.plans.compare import rows_of


def test_running_number_with_a_hot_key_equals_window(spark):
    # one customer holds a third of the rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 97).cast("long").alias("customer_id"),
        F.col("id"), (F.col("id") * 7919 % 1000).alias("score"))
    order = [F.col("score").desc(), F.col("id").asc()]
    got = running_number(df, "customer_id", order, "n", partitions=16)
    exp = df.withColumn("n", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order)))
    cols = ["customer_id", "id", "n"]
    assert rows_of(cols, got.select(*cols).collect()) == rows_of(cols, exp.select(*cols).collect())


def test_dense_retrieval_equals_brute_force_for_any_number_of_queries(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)) * rng.integers(1, 20, (900, 1))
    q = rng.normal(size=(70, 16))
    vecs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "qid long, embedding array<double>")
    want = {(i, n + 1, int(v)) for i, r in enumerate(q @ x.T) for n, v in enumerate(np.lexsort((np.arange(900), -r))[:5])}
    for slab_bytes in (1 << 24, 16 * 8 * 9):                  # one slab, and many
        got = R.retrieve_dense(queries, vecs, 5, slab_bytes=slab_bytes)
        assert {(r.qid, r.rank, r.vec_id) for r in got.collect()} == want
    skip = R.V.search_dense(vecs.coalesce(1), queries, 5, report=True).first()
    assert 0 < skip.skipped < skip.pairs                       # short vectors cannot reach the best


def _skewed(spark):
    """Chunks that all hold one token, and queries that all do."""
    chunks = spark.createDataFrame([(i, 0, f"hot a{i % 40} b{i % 17} c{i % 7}") for i in range(1200)] + [(5000, 0, "other words"), (5001, 0, "")],
                                   "doc_id long, chunk_index int, content string")
    return chunks, spark.createDataFrame([(q, f"hot a{q} b{q % 17}") for q in range(60)] + [(99, "missing"), (100, " ")], "qid long, text string")


def test_set_retrieval_with_a_token_in_every_chunk_equals_the_salted_join(spark, views):
    chunks, q = _skewed(spark)
    real = R.chunk_documents(views.knowledge.select("doc_id", "text"))
    for c, ask in ((chunks, q), (real, views.queries)):
        pairs = R.jaccard_pairs(R.token_sets(ask, ["qid"], "text"), ["qid"],
                                R.token_sets(c, ["doc_id", "chunk_index"], "content"), ["doc_id", "chunk_index"], salts=8)
        joined = R.top_k(pairs, ["qid"], [F.col("jaccard").desc(), F.col("doc_id"), F.col("chunk_index")], 4)
        want = sorted((r.qid, r.rank, r.doc_id, r.chunk_index) for r in joined.collect())
        for slab_bytes in (1 << 24, 150):
            got = R.retrieve_jaccard(ask, c, 4, slab_bytes=slab_bytes)
            assert sorted((r.qid, r.rank, r.doc_id, r.chunk_index) for r in got.collect()) == want and want
