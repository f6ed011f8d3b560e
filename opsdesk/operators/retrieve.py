"""Knowledge chunking, hashed embeddings, retrieval and index maintenance
(TX1-TX5, RET1, RET1d, RET2, IDX1-IDX4, J3, J10, J12, IO7).

Partitioning plan: documents are hash-partitioned by ``doc_id`` once
(``by_document``).  Every later aggregation is keyed by a superset of ``doc_id``
(chunk, bucket, query), so Spark reuses that partitioning: chunking, token hashing,
per-chunk sparse vectors, norms and the per-(query, chunk) dot products run without
another exchange.  The only other shuffle is the top-k per query, where the
``row_number() <= k`` filter becomes a partial WindowGroupLimit (≤ k rows per query
leave each map task).

Vectors are kept **sparse and integral**: (chunk, bucket, v) with v the signed count and
``norm2`` the squared L2 norm.  Cosine = dot / sqrt(norm2_q · norm2_c) is then bit-identical
across engines and needs no float rounding before ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import normalize_ws, round_half_up, token_bucket, token_sign, tokenize
from opsdesk.operators import vectors as V
from opsdesk.operators.index import with_content
from opsdesk.operators.vectors import top_k  # noqa: F401
from opsdesk.plans.hints import bounded, salted


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition documents by id so all per-document work below is exchange-free."""
    return docs.repartition(key)


TASK_CHARS = 4 << 20         # of the texts whose tokens one task holds


def by_volume(rows: DataFrame, keys: list[str], docs: DataFrame, text: str = "text", task_chars: int = TASK_CHARS) -> DataFrame:
    """``rows`` made from ``docs``, hash-partitioned by ``keys`` into parts of about ``task_chars``
    characters each: what a task holds does not grow with the input."""
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return rows.repartition(max(1, -(-total // task_chars)), *keys)


# ----------------------------------------------------------------------------- TX2 chunking
def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """0, step, 2·step, … while start < n (empty for n = 0)."""
    step = size - overlap
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunk_documents(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    size: int = LX.CHUNK_SIZE, overlap: int = LX.CHUNK_OVERLAP,
                    keep: list[str] | None = None) -> DataFrame:
    """TX1 + TX2: normalise whitespace, then fixed windows of ``size`` with ``overlap``.

    A per-row ``posexplode`` — no shuffle; the whole text is processed."""
    keep = keep or []
    norm = docs.select(key, *keep, normalize_ws(F.col(text)).alias("_t"))
    starts = chunk_starts(F.length("_t"), size, overlap)
    return norm.select(key, *keep, "_t", F.posexplode(starts).alias("chunk_index", "_s")).select(
        key, *keep, "chunk_index", F.substr(F.col("_t"), F.col("_s") + 1, F.lit(size)).alias("content"))


# ----------------------------------------------------------------------------- TX4 hashing
def hash_embed(rows: DataFrame, keys: list[str], text: str = "content", dims: int = LX.HASH_DIMS) -> DataFrame:
    """TX3 + TX4: signed feature hashing of lower-case word tokens into ``dims`` buckets.

    Returns the sparse long form (``keys``…, bucket, v, norm2); zero entries are dropped
    (they contribute nothing to dot products or norms)."""
    tok = rows.select(*keys, F.explode(tokenize(F.col(text))).alias("tok"))
    entries = tok.groupBy(*keys, token_bucket(F.col("tok"), dims).alias("bucket")) \
        .agg(F.sum(token_sign(F.col("tok"))).cast("bigint").alias("v")).where(F.col("v") != 0)
    w = Window.partitionBy(*keys)
    return entries.withColumn("norm2", F.sum(F.col("v") * F.col("v")).over(w))


# ----------------------------------------------------------------------------- RET1
def cosine_pairs(queries_vec: DataFrame, qkeys: list[str], corpus_vec: DataFrame, ckeys: list[str],
                 query_broadcast: bool | None = None, salts: int = 64) -> DataFrame:
    """Exact cosine of every (query, chunk) pair that shares a bucket (equi-join on bucket,
    never a cross join).

    ``query_broadcast`` True: the (checked, bounded) query vectors are broadcast and the corpus
    keeps its document partitioning — no exchange before the per-pair aggregate.  False: both
    sides are large; the 256-value bucket key is salted so the shuffle join spreads over
    256 × ``salts`` keys.  None: decide with an exact bounded count of the query side."""
    q = queries_vec.select(*qkeys, "bucket", F.col("v").alias("qv"), F.col("norm2").alias("qn2"))
    c = corpus_vec.select(*ckeys, "bucket", F.col("v").alias("cv"), F.col("norm2").alias("cn2"))
    if query_broadcast is None:
        query_broadcast = bounded(q)
    if query_broadcast:
        j = c.join(F.broadcast(q), "bucket", "inner")
    else:
        cs, qs, keys = salted(c, q, "bucket", salts, ckeys)
        j = cs.join(qs, keys, "inner").drop("_salt")
    # norms are functionally dependent on the keys: carry them as aggregates, not grouping keys
    dots = j.groupBy(*ckeys, *qkeys).agg(F.sum(F.col("qv") * F.col("cv")).alias("dot"),
                                         F.max("qn2").alias("qn2"), F.max("cn2").alias("cn2"))
    cos = F.col("dot") / F.sqrt((F.col("qn2") * F.col("cn2")).cast("double"))
    return dots.select(*qkeys, *ckeys, cos.alias("cosine"))


def sparse_arrays(rows: DataFrame, keys: list[str], text: str = "content", dims: int = LX.HASH_DIMS) -> DataFrame:
    """TX4 in array form: (keys…, b array<int>, v array<bigint>) — ≤ ``dims`` entries per row,
    sorted by bucket.  Keyed by the row key, so doc-partitioned input needs no exchange."""
    tok = rows.select(*keys, F.explode(tokenize(F.col(text))).alias("tok"))
    entries = tok.groupBy(*keys, token_bucket(F.col("tok"), dims).alias("bucket")) \
        .agg(F.sum(token_sign(F.col("tok"))).cast("bigint").alias("v")).where(F.col("v") != 0)
    packed = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "v"))).alias("e"))
    return packed.select(*keys, F.transform("e", lambda x: x["bucket"]).alias("b"),
                         F.transform("e", lambda x: x["v"]).alias("v"))


def _dense(b_lists, v_lists, dims: int):
    import numpy as np
    n = len(b_lists)
    lens = np.fromiter((len(x) for x in b_lists), dtype=np.int64, count=n)
    m = np.zeros((n, dims), dtype=np.float64)
    if lens.sum():
        rows = np.repeat(np.arange(n), lens)
        m[rows, np.concatenate(b_lists).astype(np.int64)] = np.concatenate(v_lists).astype(np.float64)
    return m


def chunk_blocks(chunks: DataFrame, group_docs: int = 512) -> DataFrame:
    """Packed vectors of chunk rows that are in no stored index."""
    rows = chunks.withColumn("commit", F.lit(""))
    groups = -(-rows.select("doc_id").distinct().count() // group_docs)
    return V.blocks_of(V.grouped(rows, groups)).withColumn("dead", F.lit(None).cast("array<bigint>"))


class ChunkCorpus:
    """Chunk rows and their metadata as something to retrieve from, like a ``VectorIndex``."""

    def __init__(self, chunks: DataFrame, chunks_meta: DataFrame):
        self.chunks, self.chunks_meta = chunks, chunks_meta

    def retrieve(self, queries: DataFrame, k: int, qid: str = "qid", text: str = "text") -> DataFrame:
        return retrieve_cosine(queries, self.chunks, self.chunks_meta, k, qid, text)


def retrieve_cosine(queries: DataFrame, chunks: DataFrame, chunks_meta: DataFrame, k: int,
                    qid: str = "qid", qtext: str = "text", slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
    """RET1 over chunk rows without a stored index (``VectorIndex.retrieve`` reads a stored one):
    the k chunks of largest cosine per query, min(k, chunks) hits for every query that is not blank;
    score = round(max(0, cosine), 3), ties by (doc_id, chunk_index)."""
    best = V.search_blocks(chunk_blocks(chunks), queries, k, qid, qtext, slab_bytes)
    return with_content(best, chunks_meta, ["doc_id", "chunk_index"], qid)


def class_centroids(vectors: DataFrame, label: str = "label", emb: str = "embedding") -> DataFrame:
    """Mean vector per class (partial aggregation per (class, dimension); dims bounded)."""
    e = vectors.select(F.col(label).alias("qid"), F.posexplode(emb).alias("i", "x"))
    per_dim = e.groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per_dim.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def retrieve_dense(queries: DataFrame, vectors: DataFrame, k: int, vid: str = "vec_id", emb: str = "embedding",
                   slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
    """RET1d: exact top-k vectors by dot product for any number of queries (qid, embedding)."""
    return V.search_dense(vectors, queries, k, vid, emb, slab_bytes)


# ----------------------------------------------------------------------------- RET2
def token_sets(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct tokens per row, exploded: (keys…, token) plus the set size."""
    s = rows.select(*keys, F.array_distinct(tokenize(F.col(text))).alias("_set"))
    return s.select(*keys, F.size("_set").alias("set_size"), F.explode("_set").alias("token"))


def jaccard_pairs(left: DataFrame, lkeys: list[str], right: DataFrame, rkeys: list[str], salts: int = 1) -> DataFrame:
    """|A∩B| / max(1, |A∪B|) for every pair sharing ≥ 1 token (inverted-index equi-join); with
    ``salts`` the right side's tokens are spread and the left side replicated."""
    lt = left.select(*lkeys, F.col("set_size").alias("ls"), "token")
    rt = right.select(*rkeys, F.col("set_size").alias("rs"), "token")
    rt, lt, keys = salted(rt, lt, "token", salts, rkeys)
    j = rt.join(lt, keys, "inner")
    inter = j.groupBy(*lkeys, *rkeys, "ls", "rs").agg(F.count(F.lit(1)).alias("inter"))
    union = F.col("ls") + F.col("rs") - F.col("inter")
    return inter.select(*lkeys, *rkeys, "inter", (F.col("inter") / F.greatest(F.lit(1), union)).alias("jaccard"))


def retrieve_jaccard(queries: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", qtext: str = "text",
                     slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
    """RET2: token-set Jaccard top-k (zero scores never appear: no shared token, no pair)."""
    best = V.search_sets(chunks, queries, k, qid, qtext, slab_bytes)
    return best.select(F.col("qid").alias(qid), "rank", "doc_id", "chunk_index", round_half_up(F.col("jaccard"), 3).alias("score"))


# ----------------------------------------------------------------------------- IDX1-4
def missing_chunks(chunks: DataFrame, indexed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chunks whose key is not yet in the vector index (left anti join)."""
    keys = keys or ["doc_id", "chunk_index"]
    return chunks.join(indexed.select(*keys).distinct(), keys, "left_anti")


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str], replaced: DataFrame) -> DataFrame:
    """IO7/X3: drop every existing row whose key is in ``replaced`` (the keys that were asked to be
    replaced, also those whose new result is empty), then append the new rows of those keys."""
    asked = replaced.select(*keys).distinct()
    return existing.join(asked, keys, "left_anti").unionByName(new.join(asked, keys, "left_semi"))


def delete_documents(documents: DataFrame, chunks: DataFrame, requests: DataFrame) -> dict:
    """IDX4/J12: cascade delete; unknown requested ids are reported, not silently ignored."""
    req = requests.select("doc_id").distinct()
    kept_docs = documents.join(req, "doc_id", "left_anti")
    kept_chunks = chunks.join(req, "doc_id", "left_anti")
    unknown = req.join(documents.select("doc_id"), "doc_id", "left_anti") \
        .select("doc_id", F.lit("Document not found.").alias("error"))
    return {"documents": kept_docs, "chunks": kept_chunks, "unknown": unknown}
