"""Exact top-k scoring of hashed chunk vectors, dense vectors and token sets (RET1, RET1d, RET2).

One path for any number of queries: the query side is dealt into *slabs* of at most a fixed number
of bytes (``SLAB_BYTES``); a slab is broadcast and the corpus is scanned once per slab.  The corpus
is never shuffled, and a task returns only its best k per query.

Chunk vectors are *blocks* of ``BLOCK_ROWS`` chunks, ordered by their strongest dimensions so that
similar chunks lie together, with the largest and smallest normalised value of every dimension.
They bound the cosine of a query with any chunk of the block, so a task first visits the blocks of
highest bound and skips, query by query, every block that cannot reach the query's current k-th
score.  Dense vectors are bounded by their norms (Cauchy-Schwarz), token sets by their sizes.

Vectors are integers (signed token counts), a cosine is dot / sqrt(norm2 * norm2) of exact integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import is_blank, tokenize
from opsdesk.session import stored

BLOCK_ROWS = 256
SLAB_BYTES = 16 << 20        # of a slab of queries, as a task holds it
EMBED_ROWS = 2048            # texts made dense at once
BUFFER = 1 << 20             # scores a task keeps before it cuts them to the best k
SLACK = 1e-9                 # bounds are sums of rounded products

BLOCK_SCHEMA = ("commit string, grp long, n int, doc_id binary, chunk_index binary, first binary, dim binary, "
                "val binary, norm2 binary, high binary, low binary, weight binary")


def top_k(pairs: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """row_number() <= k per group (planned as a partial + final WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# ----------------------------------------------------------------------------- hashing
def hashed_rows(tokens: pa.Array, dims: int = LX.HASH_DIMS) -> np.ndarray:
    """Signed token counts (rows x dims) of lists of tokens; every different token is hashed once."""
    n = len(tokens)
    flat = tokens.flatten().dictionary_encode()
    digest = [hashlib.md5(t.encode("utf-8")).digest() for t in flat.dictionary.to_pylist()]
    bucket = np.array([int.from_bytes(d[:4], "big") % dims for d in digest], np.int64)
    sign = np.array([1.0 if d[4] & 1 else -1.0 for d in digest])
    row = np.repeat(np.arange(n), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = np.asarray(flat.indices, np.int64)
    if not len(at):
        return np.zeros((n, dims), np.int64)
    return np.bincount(row * dims + bucket[at], sign[at], n * dims).astype(np.int64).reshape(n, dims)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, nnz, norm2) of the vectors of chunk rows."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_ROWS):
                some = batch.slice(at, EMBED_ROWS)
                v = hashed_rows(some.column("toks"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("chunk_index"), pa.array((v != 0).sum(1)), pa.array((v * v).sum(1))],
                    names=["doc_id", "chunk_index", "nnz", "norm2"])
    return chunks.select("doc_id", "chunk_index", tokenize(F.col("content")).alias("toks")) \
        .mapInArrow(run, "doc_id long, chunk_index int, nnz long, norm2 long")


# ----------------------------------------------------------------------------- blocks
def _pick(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start0:start0 + size0], values[start1: ...], ... one after another."""
    at = np.cumsum(size) - size
    return values[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def split_tokens(joined: pa.Array) -> pa.Array:
    """Lists of tokens from strings in which a space follows every token but the last; lists stay."""
    import pyarrow.compute as pc
    if pa.types.is_list(joined.type):
        return joined
    joined = pc.if_else(pc.equal(joined, ""), pa.scalar(None, joined.type), joined)
    return pc.split_pattern(joined, " ")


def pack_blocks(group: pa.Table) -> pa.Table:
    """Blocks of the chunks of one group (doc_id, chunk_index, toks, commit, grp[, weight]); the tokens of
    a chunk are one string, a third of the size of an array in a shuffle."""
    group = group.combine_chunks()
    parts = []
    for at in range(0, group.num_rows, EMBED_ROWS):
        v = hashed_rows(split_tokens(group.column("toks").slice(at, EMBED_ROWS).combine_chunks()))
        row, dim = np.nonzero(v)
        weight = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :3]
        parts.append((np.bincount(row, minlength=len(v)), dim, v[row, dim], weight @ np.array([1 << 32, 1 << 16, 1])))
    size, dim, val, key = (np.concatenate(p) for p in zip(*parts))
    start = np.cumsum(size) - size
    doc = group.column("doc_id").to_numpy()
    chunk = group.column("chunk_index").to_numpy()
    weight = group.column("weight").to_numpy() if "weight" in group.column_names else None
    order = np.lexsort((chunk, doc, key))
    rows = []
    for at in range(0, len(order), BLOCK_ROWS):
        me = order[at:at + BLOCK_ROWS]
        first = np.concatenate([[0], np.cumsum(size[me])]).astype(np.int32)
        d = _pick(dim, start[me], size[me]).astype(np.int16)
        v = _pick(val, start[me], size[me]).astype(np.int32)
        dense = np.zeros((len(me), LX.HASH_DIMS))
        dense[np.repeat(np.arange(len(me)), size[me]), d] = v
        norm2 = (dense * dense).sum(1).astype(np.int64)
        dense /= np.sqrt(np.maximum(norm2, 1))[:, None]
        rows.append((len(me), *(x.tobytes() for x in (doc[me].astype(np.int64), chunk[me].astype(np.int32), first, d, v,
                                                      norm2, dense.max(0), dense.min(0))),
                     b"" if weight is None else weight[me].astype(np.int64).tobytes()))
    columns = list(zip(*rows))
    return pa.table([pa.array([group.column("commit")[0].as_py()] * len(rows), pa.string()),
                     pa.array([group.column("grp")[0].as_py()] * len(rows), pa.int64()),
                     pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    names=["commit", "grp", "n", "doc_id", "chunk_index", "first", "dim", "val", "norm2", "high", "low", "weight"])


def blocks_of(chunks: DataFrame) -> DataFrame:
    """Blocks of chunk rows with commit and grp (chunks of a group meet in one task)."""
    more = [c for c in ("weight",) if c in chunks.columns]
    return chunks.select("commit", "grp", "doc_id", "chunk_index", F.array_join(tokenize(F.col("content")), " ").alias("toks"), *more) \
        .groupBy("commit", "grp").applyInArrow(pack_blocks, BLOCK_SCHEMA)


def grouped(docs: DataFrame, groups: int, key: str = "doc_id") -> DataFrame:
    return docs.withColumn("grp", F.pmod(F.xxhash64(key), F.lit(max(1, groups))))


# ----------------------------------------------------------------------------- best k
class Best:
    """The best k of every query seen so far, by score and then by the candidate's keys; ``valued``
    keeps one more value of every (query, candidate) pair."""

    def __init__(self, queries: int, k: int, keys: int, valued: bool = False):
        self.k, self.keys = k, keys
        self.theta = np.full(queries, -np.inf)       # k-th score so far
        self.kept = (np.empty(0, np.int64), np.empty(0), *[np.empty(0, np.int64)] * keys, *[np.empty(0)] * valued)
        self.more: list[tuple] = []
        self.waiting = 0
        self.cuts = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, *keys: np.ndarray, value: np.ndarray | None = None) -> None:
        """``scores`` (queries x candidates); candidates have one value of every key.  A score of
        -inf is no candidate."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        m = scores.shape[1]
        floor = self.theta[queries]
        if m > self.k:
            floor = np.maximum(floor, np.partition(scores, m - self.k, axis=1)[:, m - self.k])
        i, j = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.more.append((queries[i], scores[i, j], *(x[j] for x in keys), *([] if value is None else [value[i, j]])))
        self.waiting += len(i)
        if self.cuts < 8 or self.waiting > max(BUFFER, len(self.theta) * self.k):
            self.cut()

    def cut(self) -> None:
        cols = [np.concatenate(c) for c in zip(self.kept, *self.more)]
        order = np.lexsort((*cols[2:2 + self.keys][::-1], -cols[1], cols[0]))
        q = cols[0][order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.kept = tuple(c[keep] for c in cols)
        last = order[place == self.k - 1]
        self.theta[cols[0][last]] = cols[1][last]
        self.more, self.waiting, self.cuts = [], 0, self.cuts + 1


# ----------------------------------------------------------------------------- query slabs
def slabs_of(queries: DataFrame, size: Column, slab_bytes: int) -> list[DataFrame]:
    """``queries`` dealt evenly into parts of about ``slab_bytes``; ``size`` is a query's bytes."""
    kept = stored(queries, "queries")
    parts = max(1, -(-int(kept.agg(F.sum(size)).first()[0] or 0) // slab_bytes))
    if parts == 1:
        return [kept]
    dealt = stored(kept.repartition(parts).withColumn("slab", F.spark_partition_id()), "slabs")
    return [dealt.where(F.col("slab") == i).drop("slab") for i in range(parts)]


def per_slab(slabs: list[DataFrame], score) -> DataFrame:
    """Union of ``score(slab)`` over all slabs; with several, each is finished and written before the
    next is sent out, so one broadcast is alive at a time."""
    if len(slabs) == 1:
        return score(slabs[0])
    out = [stored(score(s), "slab-hits") for s in slabs]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


# ----------------------------------------------------------------------------- RET1
def query_vectors(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, vec, norm2) of every query that is not blank."""
    kind = queries.schema[qid].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_ROWS):
                some = batch.slice(at, EMBED_ROWS)
                v = hashed_rows(some.column("toks"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("qid"), pa.array([r.astype(np.int32).tobytes() for r in v], pa.binary()),
                     pa.array((v * v).sum(1))], names=["qid", "vec", "norm2"])
    rows = queries.where(~is_blank(F.col(text))).select(F.col(qid).alias("qid"), tokenize(F.col(text)).alias("toks"))
    return rows.mapInArrow(run, f"qid {kind.simpleString()}, vec binary, norm2 long")


class _Block:
    def __init__(self, batch: pa.RecordBatch, i: int):
        def get(name, kind):
            return np.frombuffer(batch.column(name)[i].as_py(), kind)
        self.doc, self.chunk, self.norm2 = get("doc_id", np.int64), get("chunk_index", np.int32), get("norm2", np.int64)
        self.dense = np.zeros((len(self.doc), LX.HASH_DIMS))
        self.dense[np.repeat(np.arange(len(self.doc)), np.diff(get("first", np.int32))), get("dim", np.int16)] = get("val", np.int32)
        self.commit = batch.column("commit")[i].as_py()
        self.weight = get("weight", np.int64)
        dead = batch.column("dead")[i].as_py()
        self.alive = ~np.isin(self.doc, dead) if dead else None


def _search(shared, k: int, report: bool):
    """mapInArrow body: the best k chunks of every query of the slab among a task's blocks."""
    def run(batches):
        qids, vec, qnorm2 = shared.value
        if not len(vec):
            return
        q = vec.astype(np.float64)
        unit = q / np.sqrt(np.maximum(qnorm2, 1))[:, None]
        pos, neg = np.maximum(unit, 0), np.minimum(unit, 0)
        best, commits = Best(len(q), k, 3), {}
        pairs = skipped = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                high, low = (np.stack([np.frombuffer(x, np.float64) for x in batch.column(c).to_pylist()]) for c in ("high", "low"))
                bound = pos @ high.T + neg @ low.T
                for b in np.argsort(-bound.mean(0), kind="stable").tolist():
                    pairs += len(q)
                    need = np.flatnonzero(bound[:, b] >= best.theta - SLACK)
                    skipped += len(q) - len(need)
                    if not len(need):
                        continue
                    block = _Block(batch, b)
                    commit = np.full(len(block.doc), commits.setdefault(block.commit, len(commits)))
                    for a in range(0, len(need), 1024):
                        me = need[a:a + 1024]
                        norm = np.sqrt((qnorm2[me][:, None] * block.norm2).astype(np.float64))
                        cos = (q[me] @ block.dense.T) / np.where(norm > 0, norm, 1)
                        if block.alive is not None:
                            cos[:, ~block.alive] = -np.inf
                        best.add(me, cos, block.doc, block.chunk.astype(np.int64), commit)
        best.cut()
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([skipped])], names=["pairs", "skipped"])
            return
        at, score, doc, chunk, commit = best.kept
        yield pa.RecordBatch.from_arrays(
            [qids.take(pa.array(at)), pa.array(doc), pa.array(chunk.astype(np.int32)),
             pa.array(list(commits), pa.string()).take(pa.array(commit)), pa.array(score)],
            names=["qid", "doc_id", "chunk_index", "commit", "cosine"])
    return run


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int, qid: str = "qid", text: str = "text",
                  slab_bytes: int = SLAB_BYTES, report: bool = False) -> DataFrame:
    """The k best chunks of every query that is not blank: (qid, rank, doc_id, chunk_index, commit,
    cosine); min(k, chunks) rows a query, ties to the smaller (doc_id, chunk_index).  ``blocks`` has
    the columns of BLOCK_SCHEMA and ``dead`` (ids that no longer count, or null).  With ``report``:
    the (query, block) pairs and how many were skipped."""
    vectors = query_vectors(queries, qid, text)
    kind = vectors.schema["qid"].dataType.simpleString()
    schema = "pairs long, skipped long" if report else \
        f"qid {kind}, doc_id long, chunk_index int, commit string, cosine double"
    context = queries.sparkSession.sparkContext

    def score(slab: DataFrame) -> DataFrame:
        t = slab.toArrow().combine_chunks()                      # at most slab_bytes
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.int32).reshape(-1, LX.HASH_DIMS)
        ids = t.column("qid").combine_chunks()
        shared = context.broadcast((ids, vec, t.column("norm2").to_numpy()))
        return blocks.mapInArrow(_search(shared, k, report), schema)
    found = per_slab(slabs_of(vectors, F.lit(8 * LX.HASH_DIMS), slab_bytes), score)
    if report:
        return found.agg(F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))
    return top_k(found, ["qid"], [F.col("cosine").desc(), F.col("doc_id"), F.col("chunk_index")], k)


# ----------------------------------------------------------------------------- RET1d
def search_dense(vectors: DataFrame, queries: DataFrame, k: int, vid: str = "vec_id", emb: str = "embedding",
                 slab_bytes: int = SLAB_BYTES, report: bool = False) -> DataFrame:
    """The k vectors of largest dot product for every query (qid, embedding): (qid, rank, vid, sim).

    A task takes the vectors of a batch by falling norm; once |query| * |vector| cannot reach a
    query's k-th score, the rest of the batch is left out for it."""
    kind = queries.schema["qid"].dataType.simpleString()
    q = queries.select("qid", F.col(emb).cast("array<double>").alias("e"))
    context = queries.sparkSession.sparkContext
    v = vectors.select(F.col(vid).cast("long").alias("vid"), F.col(emb).cast("array<double>").alias("e")).where("e is not null")
    schema = "pairs long, skipped long" if report else f"qid {kind}, vid long, sim double"

    def matrix(col, dims: int) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def score(slab: DataFrame) -> DataFrame:
        t = slab.toArrow().combine_chunks()
        shared = context.broadcast((t.column("qid").combine_chunks(), t.column("e").to_pylist()))

        def run(batches):
            qids, rows = shared.value
            ask = np.array(rows, np.float64).reshape(len(rows), -1)
            length = np.sqrt((ask * ask).sum(1))
            best = Best(len(ask), k, 1)
            pairs = skipped = 0
            for batch in batches:
                if not batch.num_rows or not len(ask):
                    continue
                x = matrix(batch.column("e"), ask.shape[1])
                norm = np.sqrt((x * x).sum(1))
                order = np.argsort(-norm, kind="stable")
                ids = batch.column("vid").to_numpy()
                for at in range(0, len(order), BLOCK_ROWS):
                    me = order[at:at + BLOCK_ROWS]
                    need = np.flatnonzero(length * norm[me[0]] * (1 + SLACK) >= best.theta)
                    pairs += len(ask)
                    skipped += len(ask) - len(need)
                    for a in range(0, len(need), 1024):
                        some = need[a:a + 1024]
                        best.add(some, ask[some] @ x[me].T, ids[me])
            best.cut()
            if report:
                yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([skipped])], names=["pairs", "skipped"])
            else:
                at, sim, vec = best.kept
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(vec), pa.array(sim)], names=["qid", "vid", "sim"])
        return v.mapInArrow(run, schema)

    found = per_slab(slabs_of(q, 8 * F.size("e"), slab_bytes), score)
    if report:
        return found.agg(F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))
    return top_k(found, ["qid"], [F.col("sim").desc(), F.col("vid")], k).select("qid", "rank", F.col("vid").alias(vid), "sim")


# ----------------------------------------------------------------------------- RET2
def search_sets(chunks: DataFrame, queries: DataFrame, k: int, qid: str = "qid", text: str = "text",
                slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The k chunks of largest token-set Jaccard similarity for every query that is not blank:
    (qid, rank, doc_id, chunk_index, jaccard); no shared token, no hit.

    A slab of queries is an inverted list over its own tokens, so a frequent token is a long list in
    memory and never a join key.  A chunk's size and its number of tokens that any query holds bound
    its similarity: pairs that cannot reach the query's k-th score are not counted."""
    kind = queries.schema[qid].dataType.simpleString()
    context = queries.sparkSession.sparkContext
    rows = queries.where(~is_blank(F.col(text))).select(F.col(qid).alias("qid"), F.array_distinct(tokenize(F.col(text))).alias("toks"))
    sets = chunks.select("doc_id", "chunk_index", F.array_distinct(tokenize(F.col("content"))).alias("toks"))
    schema = f"qid {kind}, doc_id long, chunk_index int, jaccard double"

    def score(slab: DataFrame) -> DataFrame:
        t = slab.toArrow().combine_chunks()
        toks = t.column("toks").combine_chunks()
        shared = context.broadcast((t.column("qid").combine_chunks(), toks))

        def run(batches):
            qids, asked = shared.value
            size = asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = asked.flatten().dictionary_encode()
            known = flat.dictionary
            member = np.repeat(np.arange(len(size)), size)
            order = np.argsort(np.asarray(flat.indices), kind="stable")
            member = member[order]
            first = np.searchsorted(np.asarray(flat.indices)[order], np.arange(len(known) + 1))
            best = Best(len(size), k, 2)
            for whole in batches:
                step = max(1, (1 << 21) // max(1, len(size)))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    inter, have = overlaps(batch.column("toks"), known, first, member, size, best.theta)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        jac = np.where(inter > 0, inter / np.maximum(1, size[:, None] + have - inter), -np.inf)
                    best.add(np.arange(len(size)), jac, batch.column("doc_id").to_numpy(),
                             batch.column("chunk_index").to_numpy().astype(np.int64))
            best.cut()
            at, jac, doc, chunk = best.kept
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(doc), pa.array(chunk.astype(np.int32)), pa.array(jac)],
                                             names=["qid", "doc_id", "chunk_index", "jaccard"])
        return sets.mapInArrow(run, schema)

    found = per_slab(slabs_of(rows, F.octet_length(F.array_join("toks", "  ")), slab_bytes), score)
    return top_k(found, ["qid"], [F.col("jaccard").desc(), F.col("doc_id"), F.col("chunk_index")], k)


def overlaps(tokens: pa.Array, known: pa.Array, first: np.ndarray, member: np.ndarray, size: np.ndarray,
             theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared tokens of every query with every chunk, tokens of the chunks)."""
    import pyarrow.compute as pc
    have = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n, queries = len(have), len(size)
    at = pc.index_in(tokens.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), have)[at >= 0]
    at = at[at >= 0]
    per = first[at + 1] - first[at]
    most = np.minimum(size[:, None], np.bincount(row, minlength=n))
    reach = most / np.maximum(1, size[:, None] + have - most) >= theta[:, None] - SLACK
    begin = np.cumsum(per) - per
    q = member[np.repeat(first[at] - begin, per) + np.arange(int(per.sum()))] if len(at) else np.empty(0, np.int64)
    cell = q * n + np.repeat(row, per)
    cell = cell[reach.ravel()[cell]]
    return np.bincount(cell, minlength=queries * n).reshape(queries, n).astype(np.int64), have
