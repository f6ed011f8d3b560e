"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (words are white-space separated, unchanged; a text of
fewer words is one shorter shingle).  Equal sets are collapsed and carry their number of copies.

1. MinHash bands (32 bands of 4 values: a pair of similarity 0.8 is missed with probability
   5e-8) give buckets; each set is linked to its bucket's smallest set, and connected components
   of these links are the coarse clusters.  Pairs inside a bucket are never expanded.
2. A cluster is cut into blocks of bounded size; every pair of blocks is one task, so a cluster of
   any size is many bounded tasks.  A task compares MinHash values incrementally, 16 at a time,
   and drops a pair as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``tolerance``; the rest is verified exactly on the shingles.
3. A task returns, per set, the number of linked documents and the smallest set it is connected
   to inside the task - never the pairs.  Sums and connected components of these give the number
   of links and the class of each document.

Cases: texts that are null or have no words have no shingles, no links and a class of their own;
repeated rows count as documents; empty tables and extra columns are fine; a null doc_id is
reported as null, its set takes part.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import carry, id_text, map_pieces, partitions, prepare, restore, stored
from opsdesk.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BAND = 128, 4
ROUND = 16                    # MinHash values compared before the next pruning
TOLERANCE = 1e-9
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1 << 20
TILE = 128                    # rows of a block compared at a time
_FACTOR = np.random.Generator(np.random.PCG64(8)).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each text, one after another."""
    data, off = S.text_bytes(texts)
    starts, ends, first = S.words(data, off)
    prefix = S.prefix_hash(S.range_hash(S.prefix_hash(S.BYTE_CODE[data]), starts, ends))
    words = first[1:] - first[:-1]
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), count)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    stop = np.minimum(begin + size, first[1:][doc])
    h = S.range_hash(prefix, begin, stop)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(words) < 65536 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(words) + 1), side="left")


def signatures(h: np.ndarray, first: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(sets, hashes) MinHash values; empty sets are not allowed."""
    x = (h >> S.U64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    out = np.empty((len(first) - 1, hashes), np.uint32)
    if len(out):
        with np.errstate(over="ignore"):
            for j in range(hashes):
                y = x * _FACTOR[j]
                y ^= y >> np.uint32(15)
                out[:, j] = np.minimum.reduceat(y, first[:-1])
    return out


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Content hash of each sorted set."""
    return S.range_hash(S.prefix_hash(h), first[:-1], first[1:]).view(np.int64)


def needed_matches(threshold: float, hashes: int = HASHES, step: int = ROUND, tolerance: float = TOLERANCE) -> list[int]:
    """Per round the fewest equal values that keep a pair: the posterior (uniform prior, so
    Beta(m + 1, n - m + 1)) of a similarity of at least ``threshold`` is not below ``tolerance``."""
    t = Fraction(threshold).limit_denominator(10**6)
    out = []
    for n in range(step, hashes + 1, step):
        # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        tail, m = Fraction(0), -1
        while True:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= Fraction(tolerance):
                break
        out.append(m)
    return out


class BlockPair:
    """Links between the sets of two blocks (or inside one)."""

    def __init__(self, ids, copies, shingles, first, sig, threshold: float, need: list[int]):
        self.ids, self.copies, self.sig, self.need = ids, copies, sig, need
        _, self.code = np.unique(shingles, return_inverse=True)
        self.vocab = int(self.code.max()) + 1 if len(self.code) else 0
        self.first = first
        self.size = first[1:] - first[:-1]
        t = Fraction(threshold).limit_denominator(10**6)
        self.num, self.den = t.numerator, t.denominator
        self.links = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))

    def candidates(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i of rows, j of cols) that survive the incremental comparison."""
        match = np.zeros((len(rows), len(cols)), np.uint8)
        for j in range(ROUND):
            match += self.sig[rows, j][:, None] == self.sig[cols, j][None, :]
        i, j = np.nonzero(match >= self.need[0])
        m = match[i, j].astype(np.int16)
        i, j = rows[i], cols[j]
        for r in range(1, HASHES // ROUND):
            if not len(i):
                break
            for c in range(ROUND * r, ROUND * (r + 1)):
                value = self.sig[:, c]
                m += value[i] == value[j]
            ok = m >= self.need[r]
            i, j, m = i[ok], j[ok], m[ok]
        return i, j

    def run(self, rows: np.ndarray, cols: np.ndarray, inside: bool) -> None:
        """Verify and count the links between two index sets (``inside``: each pair once)."""
        if not len(rows) or not len(cols):
            return
        present = np.zeros(self.vocab, bool)
        flat = np.concatenate([self.code[self.first[c]:self.first[c + 1]] for c in cols.tolist()])
        at = np.cumsum(self.size[cols]) - self.size[cols]
        where = np.empty(len(self.ids), np.int64)
        where[cols] = np.arange(len(cols))
        for t in range(0, len(rows), TILE):
            tile = rows[t:t + TILE]
            i, j = self.candidates(tile, cols)
            if inside:
                keep = i < j
                i, j = i[keep], j[keep]
            found, begin = np.unique(i, return_index=True)       # i ascends
            for r, other in zip(found.tolist(), np.split(j, begin[1:])):
                mine = self.code[self.first[r]:self.first[r + 1]]
                present[mine] = True
                if 8 * len(other) > len(cols):
                    common = np.add.reduceat(present[flat], at, dtype=np.int64)[where[other]]
                else:
                    size = self.size[other]
                    stop = np.cumsum(size)
                    pick = np.repeat(at[where[other]] - (stop - size), size) + np.arange(int(stop[-1]))
                    common = np.add.reduceat(present[flat[pick]], stop - size, dtype=np.int64)
                present[mine] = False
                union = self.size[r] + self.size[other] - common
                linked = other[common * self.den >= union * self.num]
                if len(linked):
                    self.links[r] += self.copies[linked].sum()
                    self.links[linked] += self.copies[r]
                    self._join(np.append(linked, r))

    def _join(self, members: np.ndarray) -> None:
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            to = np.arange(len(self.label))
            to[labels] = labels[0]
            self.label = to[self.label]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class of linked documents;
    its own if it has no links), n_links (other documents of similarity >= threshold, copies
    included), class_key (tells classes apart even where ids repeat; null: no words) and text_key."""
    spark = docs.sparkSession
    prepare(spark)
    bands = HASHES // BAND

    def banded(piece: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(piece.column("text"), size)
        some = np.flatnonzero(first[1:] > first[:-1])
        keys = np.zeros(piece.num_rows, np.int64)
        sub = np.append(first[some], first[-1])
        keys[some] = set_keys(h, sub)
        sig = signatures(h, sub).reshape(len(some), bands, BAND).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = S.mix((sig[:, :, 0] << S.U64(32)) + sig[:, :, 1]) * S.U64(0x9E3779B97F4A7C15) \
                + S.mix((sig[:, :, 2] << S.U64(32)) + sig[:, :, 3]) + np.arange(bands, dtype=np.uint64)
        band = S.mix(mixed.ravel()).view(np.int64)
        lists = np.zeros(piece.num_rows + 1, np.int32)
        lists[1:][some] = bands
        offsets = np.cumsum(lists).astype(np.int32)
        null = np.ones(piece.num_rows, bool)
        null[some] = False
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("text_key"), pa.array(keys, pa.int64(), mask=null),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(band))],
            names=["doc_id", "text_key", "set_key", "bands"])

    rows = id_text(docs)
    made = stored(map_pieces(rows.withColumn("text_key", F.xxhash64("text")), banded,
                             "doc_id long, text_key long, set_key long, bands array<long>"), "bands")
    sets = made.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("low"),
        F.min("text_key").alias("text_key"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")) \
        .select("set_key", F.col("low.doc_id").alias("doc"), F.coalesce("low.text_key", "text_key").alias("rep_key"),
                "copies", "bands")
    banded_sets = stored(sets, "sets")
    buckets = banded_sets.select("set_key", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("set_key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    links = buckets.join(hubs, "band").select(F.col("set_key").alias("a"), F.col("hub").alias("b"))
    coarse = components(links).withColumnsRenamed({"node": "set_key", "component": "cluster"})
    members = banded_sets.select("set_key", "doc", "rep_key", "copies").join(coarse, "set_key")

    # the shingles of clustered sets, from the text of one document each
    wanted = members.withColumnRenamed("doc", "rep")
    # (by id and content: an id, or no id, may stand in very many rows of other texts)
    texts = rows.withColumn("text_key", F.xxhash64("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))) \
        .select("text", "set_key", "copies", "cluster")

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(piece.column("text"), size)
        some = np.flatnonzero(first[1:] > first[:-1])
        keys = np.zeros(piece.num_rows, np.int64)
        keys[some] = set_keys(h, np.append(first[some], first[-1]))
        ok = keys == np.asarray(piece.column("set_key"))       # another text of equal hash: not it
        blobs = [h[first[i]:first[i + 1]].tobytes() for i in np.flatnonzero(ok)]
        pick = pa.array(np.flatnonzero(ok))
        return pa.RecordBatch.from_arrays(
            [piece.column(c).take(pick) for c in ("set_key", "copies", "cluster")]
            + [pa.array((first[1:] - first[:-1])[ok]), pa.array(blobs, pa.binary())],
            names=["set_key", "copies", "cluster", "n", "shingles"])

    schema = "set_key long, copies long, cluster long, n long, shingles binary"
    bodies = stored(map_pieces(texts, cut, schema).dropDuplicates(["set_key"]), "shingles")
    cluster_size = bodies.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1") \
        .select("cluster", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks"))
    total = bodies.agg(F.sum("n")).first()[0] or 0
    shared_tasks = max(partitions(spark), -(-total // BLOCK_SHINGLES))
    dealt = bodies.join(cluster_size, "cluster").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    # every set goes to the tasks of its block with each block; clusters of one block share tasks
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("cluster", "set_key", "copies", "shingles", "own",
                F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                F.when(F.col("blocks") > 1, F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")))
                .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(shared_tasks))).alias("task"))
    need = needed_matches(threshold)

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("cluster")), kind="stable")
        table = table.take(pa.array(order))
        cluster = np.asarray(table.column("cluster"))
        edges = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
        raw = table.column("shingles").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(b) // 8 for b in raw])])
        shingles = np.frombuffer(b"".join(raw), np.uint64)
        sig = signatures(shingles, first)
        ids, copies, own, x, y = (np.asarray(table.column(c)) for c in ("set_key", "copies", "own", "x", "y"))
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            me = slice(lo, hi)
            pair = BlockPair(ids[me], copies[me], shingles[first[lo]:first[hi]], first[lo:hi + 1] - first[lo],
                             sig[me], threshold, need)
            for a, b in {(int(p), int(q)) for p, q in zip(x[me], y[me])}:
                here = (x[me] == a) & (y[me] == b)
                pair.run(np.flatnonzero(here & (own[me] == a)), np.flatnonzero(here & (own[me] == b)), a == b)
            hit = np.flatnonzero(pair.links > 0)
            out.append((ids[me][hit], ids[me][pair.label[hit]], pair.links[hit]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"set_key": pa.array(cols[0], pa.int64()), "to": pa.array(cols[1], pa.int64()),
                         "links": pa.array(cols[2], pa.int64())})

    found = stored(tasks.groupBy("task").applyInArrow(verify, "set_key long, to long, links long"), "links")
    classes = components(found.select(F.col("set_key").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    known = banded_sets.select("set_key", "doc", "copies") \
        .join(counts, "set_key", "left").join(classes.withColumnRenamed("node", "set_key"), "set_key", "left") \
        .withColumn("component", F.coalesce("component", "set_key"))
    lowest = known.groupBy("component").agg(F.min("doc").alias("class_id"))
    per_set = known.join(lowest, "component").select(
        "set_key", "class_id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return made.select("doc_id", "text_key", "set_key").join(per_set, "set_key", "left").select(
        "doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("class_key"), "text_key")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row per class of linked documents: the smallest doc_id (of several
    rows of that id in the class the one of smallest text hash).  Rows without words stay, equal
    ones once."""
    found = near_duplicates(docs, threshold)
    first = found.where("class_key is null or doc_id <=> class_id").groupBy("class_key", "doc_id").agg(
        F.min("text_key").alias("text_key")).drop("class_key").distinct() \
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keyed = carry(docs).withColumn("key", F.xxhash64("text"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return restore(kept.dropDuplicates(["_id", "_key"]), docs)
