"""Connected components of an edge table: bounded local contraction and star steps.

Each round first contracts the edges of every task locally (union by smallest node, in chunks of
bounded size), leaving a star forest per task.  As long as the edges need several tasks of
``EDGES_PER_TASK``, a large-star and a small-star step follow: a minimum per node (partial
aggregates) joined back to the edges, so a node with very many neighbours is an aggregate plus a
skew-split join, never a list in one task.  Edges that fit one bounded task are solved by the
contraction alone.  Edge tables are written to the shared folder each round, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm.common import releasing, stored

EDGES_PER_TASK = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the edges: every node but the smallest of its component, with that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:                                        # to the roots
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _local_forest(batches):
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held = []
    size = 0
    for batch in batches:
        held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
        size += batch.num_rows
        if size >= EDGES_PER_TASK:
            a, b = contract(*(np.concatenate(c) for c in zip((a, b), *held)))
            held, size = [], 0
    if held:
        a, b = contract(*(np.concatenate(c) for c in zip((a, b), *held)))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its component for every node with an edge.
    ``edges`` has columns a and b (long); direction, repeats and loops do not matter."""
    pairs = stored(edges.where("a <> b").select("a", "b"), "edges")
    before = _state(pairs)
    while before[0]:
        tasks = -(-before[0] // EDGES_PER_TASK)
        forest = pairs.coalesce(tasks).mapInArrow(releasing(_local_forest), "a long, b long")
        if tasks == 1:
            pairs = stored(forest, "edges")
            break
        pairs = stored(_small_star(_large_star(forest)), "edges")
        after = _state(pairs)
        if after == before:
            break
        before = after
    # a star forest: every edge leads to the smallest node of its component
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the node's smallest neighbour (or itself)."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest of them."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
