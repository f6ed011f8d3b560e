"""Exact top-k inner-product search: Voronoi kNN join over integer vectors.

Pivots (a bounded sample of vectors, ``n_pivots``) cut the space into cells; every vector goes to
the cell of its nearest pivot.  One aggregate per cell (radius, largest norm, count) is the summary
of the data, another that of the queries.  For a query cell with pivot a and radius ra and a data
cell with pivot p and radius rp every inner product q.x lies within

    q.x >= a.p - ra |p| - (|a| + ra) rp        q.x <= a.p + ra |p| + (|a| + ra) rp

Taking data cells by falling lower bound until they hold k vectors (besides the query itself)
gives a threshold theta that the k-th best score of every query of the cell reaches.  A vector x is
replicated to a query cell only if its own upper bound a.x + ra |x| reaches theta.  Queries use no more
cells than they fill blocks, as every cell can need most of the data in many dimensions.  Cells are
solved locally by blocks: query blocks of bounded size against slices of the replicated vectors of
bounded expected size, each keeping its k best, and a final top-k per query merges the slices.  A
hot cell or a hot vector is therefore many slices, never one task, and results are exact.

Components are floor(scale * x) as integers, so scores are exact integers.  Ties go to the smaller
vec_id.  Vectors that are null or hold null or non-finite components take no part, nor do null ids.
All rows with the query's own vec_id are excluded from its candidates; repeated candidate rows
count each for itself; repeated query rows (same id and vector) give one result.  Vectors of
different lengths never meet.  Empty tables and extra columns are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm.common import partitions, prepare, stored

N_PIVOTS = 64
SLICE_ROWS = 32_768          # expected vectors of a slice
QUERY_ROWS = 2_048           # expected queries of a block
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dim): integer vectors of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(finite)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"),
                       F.size("x").alias("dim"))


def _matrix(column) -> np.ndarray:
    """(rows, dim) float64 matrix of a list column with equal lengths (integers: exact)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (m * m).sum(1)[:, None] - 2 * (m @ pivots.T) + (pivots * pivots).sum(1)
    cell = d.argmin(1)
    # the distance itself without cancellation
    return cell, np.sqrt(((m - pivots[cell]) ** 2).sum(1))


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                cell, dist = _nearest(m, pivots)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(dist)],
                    names=["vec_id", "v", "cell", "dist"])
    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cell int, dist double")


def _thresholds(pivots: np.ndarray, q_radius: np.ndarray, has_q: np.ndarray, d_radius: np.ndarray,
                d_count: np.ndarray, k: int, own: int) -> np.ndarray:
    """theta per query cell: a score that k candidates of each of its queries reach (-inf: fewer)."""
    norm = np.sqrt((pivots * pivots).sum(1))
    theta = np.full(len(pivots), -np.inf)
    for a in np.flatnonzero(has_q):
        low = pivots[a] @ pivots.T - q_radius[a] * norm - (norm[a] + q_radius[a]) * d_radius
        low[d_count == 0] = -np.inf
        order = np.argsort(-low)
        enough = np.cumsum(d_count[order]) >= k + own       # the query's own rows are no candidates
        if enough.any():
            value = low[order[int(np.argmax(enough))]]
            theta[a] = value - 1e-6 * (1 + abs(value))      # slack for rounding in the bounds
    return theta


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, n_pivots: int = N_PIVOTS,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows of ``data`` for every row of ``queries`` by integer inner product:
    query_id, rank (from 1), vec_id, score."""
    spark = data.sparkSession
    prepare(spark)
    base = integer_vectors(data, id_col, vec_col, scale)
    asked = integer_vectors(queries, id_col, vec_col, scale).dropDuplicates(["vec_id", "v"])
    results = None
    for row in base.select("dim").distinct().orderBy("dim").toLocalIterator():     # as a rule one length
        dim = row["dim"]
        part = _top_k_dim(base.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), k, n_pivots) \
            if dim > 0 else None
        if part is not None:
            results = part if results is None else results.unionByName(part)
    return results if results is not None else spark.createDataFrame([], RESULT)


def _top_k_dim(base: DataFrame, asked: DataFrame, k: int, n_pivots: int) -> DataFrame | None:
    sample = base.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(n_pivots).collect()
    if not sample:
        return None
    pivots = np.array([r["v"] for r in sample], np.float64)          # at most n_pivots vectors
    data = stored(_assign(base, pivots), "knn-data")
    # no more query cells than blocks of queries: every cell may need most of the data
    groups = min(len(pivots), max(1, -(-asked.count() // QUERY_ROWS)))
    ask = stored(_assign(asked, pivots[:groups]), "knn-queries")
    n = len(pivots)
    d_radius, d_count = np.zeros(n), np.zeros(n, np.int64)
    for r in data.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        d_radius[r["cell"]], d_count[r["cell"]] = r["r"], r["n"]
    q_radius, q_count = np.zeros(n), np.zeros(n, np.int64)
    for r in ask.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        q_radius[r["cell"]], q_count[r["cell"]] = r["r"], r["n"]
    # rows that share one id: the most that a query's own id can take away from its candidates
    own = data.join(ask.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count() \
        .agg(F.max("count")).first()[0] or 0
    theta = _thresholds(pivots, q_radius, q_count > 0, d_radius, d_count, k, int(own))
    cells = np.flatnonzero(q_count > 0)
    if not len(cells):
        return None
    corners, reach, floor_ = pivots[cells], q_radius[cells], theta[cells]
    slices = max(1, -(-int(d_count.sum()) // SLICE_ROWS))
    blocks = np.maximum(1, -(-q_count // QUERY_ROWS))

    def replicate(batches):
        """A vector goes to each (query cell, block) whose threshold its upper bound reaches."""
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            norm = np.sqrt((m * m).sum(1))
            for i, a in enumerate(cells.tolist()):
                upper = m @ corners[i] + reach[i] * norm
                pick = np.flatnonzero(upper + 1e-6 * (1 + np.abs(upper)) >= floor_[i])
                if len(pick):
                    sub = b.take(pa.array(pick))
                    ids = np.asarray(sub.column("vec_id"))
                    for q in range(int(blocks[a])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(pick), a, np.int32)), pa.array(np.full(len(pick), q, np.int32)),
                             pa.array(_slice_of(ids, slices)), sub.column("vec_id"), sub.column("v")],
                            names=["cell", "block", "slice", "vec_id", "v"])

    def spread(batches):
        """A query goes to every slice of its own cell and block (a stated query set)."""
        for b in batches:
            for s in range(slices if b.num_rows else 0):
                cell = np.asarray(b.column("cell"))
                block = _block_of(np.asarray(b.column("vec_id")), blocks[cell])
                yield pa.RecordBatch.from_arrays(
                    [b.column("cell"), pa.array(block), pa.array(np.full(b.num_rows, s, np.int32)),
                     b.column("vec_id"), b.column("v")], names=["cell", "block", "slice", "vec_id", "v"])

    def solve(key, q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "qkey": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        x = x.sort_by([("vec_id", "ascending")])
        ids = np.asarray(x.column("vec_id"))
        m = _matrix(x.column("v"))
        qid, qm = np.asarray(q.column("vec_id")), _matrix(q.column("v"))
        out = []
        step = max(1, (8 << 20) // max(1, len(ids)))
        for i in range(0, len(qid), step):
            score = np.rint(qm[i:i + step] @ m.T).astype(np.int64)
            own = qid[i:i + step, None] == ids[None, :]
            # one unique number per candidate: score, then the smaller position (= smaller id)
            order = score * len(ids) + np.arange(len(ids))[::-1]
            order[own] = np.iinfo(np.int64).min
            if len(ids) > k:
                best = np.argpartition(order, len(ids) - k, axis=1)[:, len(ids) - k:]
            else:
                best = np.broadcast_to(np.arange(len(ids)), order.shape)
            ok = ~np.take_along_axis(own, best, 1)
            r, c = np.nonzero(ok)
            out.append((i + r, best[r, c], np.take_along_axis(score, best, 1)[r, c]))
        row, col, score = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": pa.array(qid[row]), "qkey": pa.array(_row_key(qm)[row]),
                         "vec_id": pa.array(ids[col]), "score": pa.array(score)})

    keys = ["cell", "block", "slice"]
    schema = "cell int, block int, slice int, vec_id long, v array<long>"
    moved = data.select("vec_id", "v").mapInArrow(replicate, schema)
    sent = ask.select("vec_id", "v", "cell").mapInArrow(spread, schema)
    found = sent.groupBy(*keys).cogroup(moved.groupBy(*keys)).applyInArrow(
        solve, "query_id long, qkey long, vec_id long, score long")
    from pyspark.sql.window import Window
    w = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    return (_scramble(ids) % np.uint64(slices)).astype(np.int32)


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (_scramble(ids) // np.uint64(1 << 20) % blocks.astype(np.uint64)).astype(np.int32)


def _scramble(ids: np.ndarray) -> np.ndarray:
    from opsdesk.llm.textscan import mix
    return mix(ids.astype(np.int64).view(np.uint64))


def _row_key(m: np.ndarray) -> np.ndarray:
    """Tells apart query rows that share an id but not the vector."""
    from opsdesk.llm.textscan import prefix_hash, range_hash
    n, d = m.shape
    p = prefix_hash(np.ascontiguousarray(m).astype(np.int64).view(np.uint64).ravel())
    return range_hash(p, np.arange(n) * d, np.arange(1, n + 1) * d).view(np.int64)


def embedding_neighbours(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """The registered query: rows whose vec_id is divisible by 20 against all rows."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), k)
