"""Catalogue, part 2: text, retrieval, index maintenance and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.embed import counted_embedder, embed_column, vector_stats
from opsdesk.functions.text import normalize_ws, tokenize
from opsdesk.operators import retrieve as R
from opsdesk.operators import similar as SIM
from opsdesk.operators import vectors as V
from opsdesk.operators.index import NO_TEXT
from opsdesk.plans.knowledge import FIRST_RUN, draft_index, knowledge_index
from opsdesk.plans.registry import query
from opsdesk.sources.views import AS_OF

P = LX.TOKEN_PATTERN
K_SEARCH = LX.K_SEARCH


def _bucket_sql(w: str) -> str:
    return f"CAST(concat('0x', substr(md5({w}), 1, 8)) AS BIGINT) % {LX.HASH_DIMS}"


def _sign_sql(w: str) -> str:
    return f"CASE WHEN CAST(concat('0x', substr(md5({w}), 9, 2)) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END"


def vectors_sql(source: str, keys: str, text: str) -> str:
    """Sparse hashed vectors (keys…, bucket, v, norm2) of ``text`` in ``source``."""
    return f"""
SELECT {keys}, bucket, v, sum(v * v) OVER (PARTITION BY {keys}) AS norm2 FROM (
  SELECT {keys}, {_bucket_sql('w')} AS bucket, sum({_sign_sql('w')}) AS v
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{P}')) AS w FROM {source})
  GROUP BY ALL HAVING sum({_sign_sql('w')}) <> 0)"""


# (the class holds braces of its own: doubled for str.format)
NORM_SQL = "trim(regexp_replace({x}, '" + LX.WHITESPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"
CHUNKS_SQL = f"""
SELECT doc_id, CAST(s // {LX.CHUNK_SIZE - LX.CHUNK_OVERLAP} AS BIGINT) AS chunk_index,
       substr(t, s + 1, {LX.CHUNK_SIZE}) AS content
FROM (SELECT doc_id, t, unnest(CASE WHEN length(t) > 0
                                    THEN generate_series(0, length(t) - 1, {LX.CHUNK_SIZE - LX.CHUNK_OVERLAP})
                                    ELSE [] END) AS s
      FROM (SELECT doc_id, {NORM_SQL.format(x='text')} AS t FROM knowledge))"""
CVEC_SQL = vectors_sql("chunks", "doc_id, chunk_index", "content")


def chunks_of(v, meta: bool = False):
    """Chunks of every knowledge document; with ``meta`` the file name and type travel with
    each chunk (no later join against the document table)."""
    keep = ["filename", "document_type"] if meta else []
    return R.chunk_documents(R.by_document(v.knowledge), keep=keep)


def chunk_vectors(v, chunks=None):
    keys = ["doc_id", "chunk_index"]
    if chunks is None:
        chunks = R.by_volume(R.chunk_documents(v.knowledge), keys, v.knowledge)
    return R.hash_embed(chunks, keys)


# ----------------------------------------------------------------------------- TX1-TX4

@query("normalize_text", sql=f"SELECT doc_id, {NORM_SQL.format(x='text')} AS text_norm FROM documents")
def _normalize_text(v):
    """TX1: whitespace collapse + strip over whole documents."""
    return v.table("documents").select("doc_id", normalize_ws(F.col("text")).alias("text_norm"))


@query("chunk_documents", sql=f"SELECT * FROM ({CHUNKS_SQL})")
def _chunk_documents(v):
    """TX2: 850-char windows with 120 overlap over every knowledge document."""
    return chunks_of(v).select("doc_id", "chunk_index", "content")


@query("tokenize", sql=f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_distinct,
       md5(array_to_string(toks, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{P}') AS toks FROM documents)""")
def _tokenize(v):
    """TX3: Unicode word tokens of every document (count, distinct count, digest of the sequence)."""
    t = v.table("documents").select("doc_id", tokenize(F.col("text")).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct("toks")).cast("bigint").alias("n_distinct"),
                    F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


@query("hash_embed", sql=f"WITH chunks AS ({CHUNKS_SQL}) {CVEC_SQL}")
def _hash_embed(v):
    """TX4: signed md5 feature hashing of every chunk, sparse integer form."""
    return chunk_vectors(v)


@query("embed_batch", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL})
SELECT c.doc_id, c.chunk_index, {LX.HASH_DIMS} AS dims, CAST(count(cv.bucket) AS BIGINT) AS nnz,
       CAST(coalesce(sum(cv.v * cv.v), 0) AS BIGINT) AS norm2, CAST(coalesce(sum(cv.v * cv.bucket), 0) AS BIGINT) AS moment
FROM chunks c LEFT JOIN cv ON cv.doc_id = c.doc_id AND cv.chunk_index = c.chunk_index GROUP BY c.doc_id, c.chunk_index""")
def _embed_batch(v):
    """TX5: Arrow-batched embedder plugged in over every chunk (md5 feature hashing, whose vectors SQL
    can check): size, non-zero entries, squared norm and first moment of the unscaled vectors."""
    e = R.by_volume(R.chunk_documents(v.knowledge), ["doc_id", "chunk_index"], v.knowledge) \
        .select("doc_id", "chunk_index", vector_stats(embed_column(F.col("content"), counted_embedder)).alias("s"))
    return e.select("doc_id", "chunk_index", "s.*")


# ----------------------------------------------------------------------------- J3 / RET

@query("chunk_list", sql=f"""
WITH chunks AS ({CHUNKS_SQL})
SELECT c.doc_id, c.chunk_index, k.filename, k.document_type, CAST(length(c.content) AS BIGINT) AS chunk_chars
FROM chunks c JOIN knowledge k ON k.doc_id = c.doc_id""")
def _chunk_list(v):
    """Chunks ⋈ documents."""
    c = chunks_of(v, meta=False)
    # chunks are hash-partitioned by doc_id already: a merge join shuffles only the document side
    meta = v.knowledge.select("doc_id", "filename", "document_type").hint("merge")
    return c.join(meta, "doc_id", "inner").select(
        "doc_id", "chunk_index", "filename", "document_type", F.length("content").cast("bigint").alias("chunk_chars"))


def best_chunks_sql(asked: str, vectors: str, key: str, k: int) -> str:
    """The k best chunks (of cv and chunks) of every row of ``asked`` by its hashed vector."""
    return f"""
SELECT {key}, doc_id, chunk_index, cosine, row_number() OVER (PARTITION BY {key} ORDER BY cosine DESC, doc_id, chunk_index) AS rank
FROM (SELECT q.{key}, c.doc_id, c.chunk_index, coalesce(d.cosine, 0.0) AS cosine
      FROM {asked} q CROSS JOIN (SELECT doc_id, chunk_index FROM chunks) c LEFT JOIN (
        SELECT x.{key}, y.doc_id, y.chunk_index, sum(x.v * y.v) / sqrt(CAST(x.norm2 * y.norm2 AS DOUBLE)) AS cosine
        FROM {vectors} x JOIN cv y ON x.bucket = y.bucket GROUP BY x.{key}, y.doc_id, y.chunk_index, x.norm2, y.norm2) d
      ON d.{key} = q.{key} AND d.doc_id = c.doc_id AND d.chunk_index = c.chunk_index)
QUALIFY rank <= {k}"""


def _retrieve_sql(k: int) -> str:
    return f"""
WITH chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL}),
asked AS (SELECT * FROM queries WHERE length(trim(text)) > 0),
qv AS ({vectors_sql("asked", "qid", "text")}),
best AS ({best_chunks_sql("asked", "qv", "qid", k)})
SELECT b.qid, b.rank, b.doc_id, b.chunk_index, k.filename, k.document_type, ch.content,
       floor(greatest(0.0, b.cosine) * 1000 + 0.5) / 1000 AS score
FROM best b JOIN chunks ch ON ch.doc_id = b.doc_id AND ch.chunk_index = b.chunk_index
JOIN knowledge k ON k.doc_id = b.doc_id"""


@query("retrieve_cosine", sql=_retrieve_sql(K_SEARCH), floats=["score"])
def _retrieve_cosine(v):
    """RET1 + S6 + J14: cosine top-5 of every benchmark query over every knowledge chunk."""
    return knowledge_index(v).retrieve(v.queries, K_SEARCH)


@query("retrieve_jaccard", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
qt AS (SELECT qid, len(toks) AS ls, unnest(toks) AS token FROM
       (SELECT qid, list_distinct(regexp_extract_all(lower(text), '{P}')) AS toks FROM queries
        WHERE length(trim(text)) > 0)),
ct AS (SELECT doc_id, chunk_index, len(toks) AS rs, unnest(toks) AS token FROM
       (SELECT doc_id, chunk_index, list_distinct(regexp_extract_all(lower(content), '{P}')) AS toks FROM chunks)),
pairs AS (SELECT qid, doc_id, chunk_index, count(*) AS inter, ls, rs FROM qt JOIN ct USING (token)
          GROUP BY qid, doc_id, chunk_index, ls, rs),
best AS (SELECT qid, doc_id, chunk_index, inter / greatest(1, ls + rs - inter) AS jaccard,
                row_number() OVER (PARTITION BY qid ORDER BY inter / greatest(1, ls + rs - inter) DESC, doc_id,
                                   chunk_index) AS rank
         FROM pairs QUALIFY rank <= {K_SEARCH})
SELECT qid, rank, doc_id, chunk_index, floor(jaccard * 1000 + 0.5) / 1000 AS score FROM best""", floats=["score"])
def _retrieve_jaccard(v):
    """RET2 + X1: token-set Jaccard top-5 via an inverted-index join."""
    return R.retrieve_jaccard(v.queries, chunks_of(v), K_SEARCH)


@query("retrieve_dense", sql="""
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label AS qid, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY label, i),
pairs AS (SELECT c.qid, e.vec_id, sum(c.m * CAST(e.x AS DOUBLE)) AS sim FROM e JOIN c ON c.i = e.i
          GROUP BY c.qid, e.vec_id)
SELECT qid, rank, vec_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5""",
       floats=["sim"])
def _retrieve_dense(v):
    """RET1d: exact dense top-5 over stored embeddings for each class-centroid query."""
    e = v.table("embeddings")
    return R.retrieve_dense(R.class_centroids(e), e, 5)


# ----------------------------------------------------------------------------- IDX

@query("index_documents", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL}),
n AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY 1),
e AS (SELECT doc_id, count(*) AS entries FROM cv GROUP BY 1)
SELECT k.doc_id, k.filename, k.document_type,
       CASE WHEN coalesce(n.chunk_count, 0) > 0 THEN 'Indexed' ELSE 'Rejected' END AS status,
       CAST(coalesce(n.chunk_count, 0) AS BIGINT) AS chunk_count,
       CASE WHEN coalesce(n.chunk_count, 0) > 0 THEN coalesce(k.indexed_at, TIMESTAMP '{AS_OF}') END AS indexed_at,
       CASE WHEN coalesce(n.chunk_count, 0) = 0 THEN '{NO_TEXT}' END AS error,
       CAST(coalesce(n.chunk_count, 0) AS BIGINT) AS vectors, CAST(coalesce(e.entries, 0) AS BIGINT) AS entries
FROM knowledge k LEFT JOIN n ON n.doc_id = k.doc_id LEFT JOIN e ON e.doc_id = k.doc_id""")
def _index_documents(v):
    """IDX1: registry of the stored index after two successive runs, with the vectors and vector
    entries that it holds for every document."""
    index = knowledge_index(v)
    held = index.vector_stats().groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"), F.sum("nnz").alias("entries"))
    return index.documents().join(held, "doc_id", "left").select(
        "doc_id", "filename", "document_type", "status", "chunk_count", "indexed_at", "error",
        F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("entries", F.lit(0)).alias("entries"))


@query("index_missing", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
missing AS (SELECT c.* FROM chunks c WHERE c.doc_id NOT IN (SELECT doc_id FROM knowledge WHERE indexed_at IS NOT NULL)),
mv AS ({vectors_sql("missing", "doc_id, chunk_index", "content")})
SELECT m.doc_id, m.chunk_index, CAST(count(mv.bucket) AS BIGINT) AS nnz, CAST(coalesce(max(mv.norm2), 0) AS BIGINT) AS norm2
FROM missing m LEFT JOIN mv ON mv.doc_id = m.doc_id AND mv.chunk_index = m.chunk_index
GROUP BY m.doc_id, m.chunk_index""")
def _index_missing(v):
    """IDX2 + J10 + X2: chunk and embed only the documents that the index of the first run lacks."""
    missing = knowledge_index(v).at(FIRST_RUN).missing(v.knowledge)
    return V.chunk_stats(R.chunk_documents(missing))


@query("doc_reindex", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL})
SELECT k.doc_id, CAST(count(DISTINCT cv.chunk_index) AS BIGINT) AS indexed_chunks, CAST(count(cv.bucket) AS BIGINT) AS entries,
       CASE WHEN k.indexed_at IS NOT NULL THEN k.indexed_at
            WHEN length(trim(k.text)) > 0 THEN TIMESTAMP '{AS_OF}' END AS indexed_at
FROM knowledge k LEFT JOIN cv ON cv.doc_id = k.doc_id GROUP BY k.doc_id, k.indexed_at, k.text""")
def _doc_reindex(v):
    """IDX3 + IO7: documents that were indexed from a draft are indexed anew from their text: the
    draft's chunks and vectors go out of force, all others stay, and their time is refreshed."""
    index = draft_index(v)
    after = index.at(index.reindex(v.knowledge.where("indexed_at IS NULL"), AS_OF))
    held = after.vector_stats().where("nnz > 0").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("indexed_chunks"), F.sum("nnz").alias("entries"))
    return after.documents().select("doc_id", "indexed_at").join(held, "doc_id", "left").select(
        "doc_id", F.coalesce("indexed_chunks", F.lit(0)).alias("indexed_chunks"),
        F.coalesce("entries", F.lit(0)).alias("entries"), "indexed_at")


@query("doc_delete", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
req AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1
                                     UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE quality = 0 AND toxic = 1)),
kept AS (SELECT k.doc_id, CAST(count(c.chunk_index) AS BIGINT) AS chunk_count, CAST(NULL AS VARCHAR) AS error
         FROM knowledge k LEFT JOIN chunks c ON c.doc_id = k.doc_id
         WHERE k.doc_id NOT IN (SELECT doc_id FROM req) GROUP BY k.doc_id)
SELECT * FROM kept
UNION ALL
SELECT doc_id, NULL, 'Document not found.' FROM req WHERE doc_id NOT IN (SELECT doc_id FROM knowledge)""")
def _doc_delete(v):
    """IDX4 + J12: cascade delete of requested documents; unknown ids reported."""
    lab = v.table("labels")
    req = lab.where(F.col("toxic") == 1).select("doc_id").unionByName(
        lab.where((F.col("quality") == 0) & (F.col("toxic") == 1)).select((F.col("doc_id") + 1000000000).alias("doc_id")))
    out = R.delete_documents(v.knowledge.select("doc_id"), chunks_of(v), req)
    counts = out["chunks"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = out["documents"].join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunk_count"),
        F.lit(None).cast("string").alias("error"))
    unknown = out["unknown"].select("doc_id", F.lit(None).cast("bigint").alias("chunk_count"), "error")
    return kept.unionByName(unknown)


# ----------------------------------------------------------------------------- SIM

SIM_SQL = f"""
t AS (SELECT id AS ticket_id, created_at, status,
             concat(coalesce(subject, ''), ' ', coalesce(description, '')) AS text FROM tickets),
tx AS (SELECT text, min(ticket_id) AS rep, count(*) AS copies FROM t GROUP BY text),
tg AS (SELECT t.ticket_id, t.created_at, t.status, tx.rep FROM t JOIN tx ON tx.text = t.text),
tv AS ({vectors_sql("tx", "rep", "text")}),
sc AS (SELECT * FROM (
         SELECT l.rep AS a, r.rep AS b, sum(l.v * r.v) / sqrt(CAST(l.norm2 * r.norm2 AS DOUBLE)) AS cosine
         FROM tv l JOIN tv r ON l.bucket = r.bucket GROUP BY l.rep, r.rep, l.norm2, r.norm2)
       WHERE cosine >= {LX.SIMILAR_MIN_SCORE}),
newest AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY created_at DESC, ticket_id) AS nr FROM tg
           QUALIFY nr <= {LX.SIMILAR_TOP + 1}),
p AS (SELECT sc.a, n.ticket_id AS matched_ticket_id, n.created_at AS cand_created,
             floor(sc.cosine * 1000 + 0.5) / 1000 AS score,
             CASE WHEN sc.cosine >= {LX.DUPLICATE_MIN_SCORE} THEN 'probable_duplicate'
                  WHEN n.status IN ('Resolved', 'Closed') THEN 'resolved_case' ELSE 'similar' END AS match_type,
             row_number() OVER (PARTITION BY sc.a ORDER BY floor(sc.cosine * 1000 + 0.5) DESC, n.created_at DESC,
                                n.ticket_id) AS pr
      FROM sc JOIN newest n ON n.rep = sc.b QUALIFY pr <= {LX.SIMILAR_TOP + 1}),
top8 AS (SELECT tg.ticket_id, p.matched_ticket_id, p.score, p.match_type,
                row_number() OVER (PARTITION BY tg.ticket_id ORDER BY p.score DESC, p.cand_created DESC, p.matched_ticket_id)
                  AS rank
         FROM tg JOIN p ON p.a = tg.rep AND p.matched_ticket_id <> tg.ticket_id QUALIFY rank <= {LX.SIMILAR_TOP}),
dg AS (SELECT sc.a AS group_id, sc.b AS matched_group_id, floor(sc.cosine * 1000 + 0.5) / 1000 AS score,
              x.copies AS tickets, y.copies AS matched_tickets
       FROM sc JOIN tx x ON x.rep = sc.a JOIN tx y ON y.rep = sc.b WHERE sc.cosine >= {LX.DUPLICATE_MIN_SCORE}),
dupc AS (SELECT tg.ticket_id, d.duplicate_count
         FROM tg JOIN (SELECT group_id, sum(matched_tickets) - 1 AS duplicate_count FROM dg GROUP BY 1) d
           ON d.group_id = tg.rep WHERE d.duplicate_count > 0)"""


@query("similar_tickets", sql=f"WITH {SIM_SQL} SELECT * FROM top8", floats=["score"])
def _similar_tickets(v):
    """SIM1 + S5 + S9 + J13: top-8 similar tickets among all others."""
    return SIM.similar_tickets(v.tickets)["similar"]


@query("similar_duplicates", sql=f"""
WITH {SIM_SQL} SELECT group_id, matched_group_id, score, tickets, matched_tickets FROM dg
WHERE group_id < matched_group_id OR (group_id = matched_group_id AND tickets > 1)""", floats=["score"])
def _similar_duplicates(v):
    """SIM1: every probable duplicate (score ≥ .72) as pairs of copy groups with their sizes."""
    return SIM.duplicate_pairs(v.tickets)


@query("replace_similarity", sql=f"""
WITH {SIM_SQL},
esc AS (SELECT id FROM tickets WHERE status = 'Escalated')
SELECT ticket_id, matched_ticket_id, score, match_type FROM top8
WHERE ticket_id NOT IN (SELECT id FROM esc) OR match_type = 'probable_duplicate'""", floats=["score"])
def _replace_similarity(v):
    """IO7 + X3: replace the similarity rows of escalated tickets by their probable duplicates."""
    existing = SIM.similar_tickets(v.tickets)["similar"].drop("rank")
    esc = v.tickets.where(F.col("status") == "Escalated").select(F.col("id").alias("ticket_id"))
    return R.replace_by_key(existing, existing.where(F.col("match_type") == "probable_duplicate"), ["ticket_id"], esc)


@query("near_duplicates", sql=f"""
WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{P}'))) AS toks FROM documents),
g AS (SELECT toks, min(doc_id) AS d, count(*) AS copies FROM s WHERE len(toks) > 0 GROUP BY toks),
t AS (SELECT d, len(toks) AS n, copies, unnest(toks) AS token FROM g),
c AS (SELECT a.d AS doc_a, b.d AS doc_b, count(*) AS inter, a.n AS na, b.n AS nb, a.copies AS copies_a,
             b.copies AS copies_b
      FROM t a JOIN t b ON a.token = b.token AND a.d < b.d GROUP BY a.d, b.d, a.n, b.n, a.copies, b.copies)
SELECT doc_a, doc_b, inter, na + nb - inter AS union_size, inter / (na + nb - inter) AS jaccard, copies_a, copies_b
FROM c WHERE inter / (na + nb - inter) >= {LX.DUPLICATE_MIN_SCORE}""", floats=["jaccard"])
def _near_duplicates(v):
    """SIM2: exact corpus-wide near-duplicate pairs (prefix-filtered inverted index)."""
    return SIM.near_duplicates(v.table("documents"))


@query("exact_duplicates", sql=f"""
WITH h AS (SELECT doc_id, sha256({NORM_SQL.format(x='lower(text)')}) AS dup_key FROM documents),
g AS (SELECT dup_key, min(doc_id) AS canonical_doc_id, count(*) AS group_size FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT h.doc_id, h.dup_key, g.canonical_doc_id, g.group_size, h.doc_id <> g.canonical_doc_id AS is_copy
FROM h JOIN g USING (dup_key)""")
def _exact_duplicates(v):
    """SIM3: exact duplicates by hash of the normalised text."""
    return SIM.exact_duplicates(v.table("documents"))


@query("doc_inventory", sql=f"""
WITH chunks AS ({CHUNKS_SQL})
SELECT k.doc_id, k.filename, k.document_type, k.uploaded_at, CAST(count(c.chunk_index) AS BIGINT) AS chunk_count,
       CAST(coalesce(k.indexed_at, k.uploaded_at) AS DATE) AS last_update
FROM knowledge k LEFT JOIN chunks c ON c.doc_id = k.doc_id
GROUP BY k.doc_id, k.filename, k.document_type, k.uploaded_at, k.indexed_at""")
def _doc_inventory(v):
    """A24 + S8: documents with chunk counts and last update, newest upload first."""
    from opsdesk.operators.metrics import doc_inventory
    return doc_inventory(v.knowledge, chunks_of(v))
