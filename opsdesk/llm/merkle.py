"""Merkle dataset manifest: a persistent, path-copying hash tree over the rows of documents.

A leaf is the SHA-256 of a row's fields; every language has a tree whose runs of ``FANOUT`` nodes
become their hash, and the languages' subroots are the leaves of one more tree.  A tampered leaf
makes a *version*: only the nodes on its way to the root are copied, all others are shared with the
tree it came from.

Spark deals a tree out in aligned blocks of ``FANOUT ** depth`` (4096) nodes, so a block is a whole
subtree and no group is larger, whatever a language's share of the rows:

1. leaf digests (JVM), then exact positions per language by range partitioning;
2. block roots become the nodes of the next, 4096 times smaller table, until a tree has one node;
3. the way back down gives every block the siblings of its ancestors (a few kilobytes a block);
4. the leaf blocks, together with those siblings, make the versions: copies inside the block by
   ``PathCopyTree``, continued above it through the shared siblings, spread over all tasks.

Every table between the steps is written to the shared folder.

Cases: null fields hash as ``-``; a null language is a tree of its own, before all others; rows
equal in language and doc_id are ordered by their leaf (rows equal in all fields are
interchangeable); a null doc_id comes first and is never tampered with by the query; a lone leaf is
its own subroot; an empty table gives empty results; extra columns are ignored.  A text is hashed
where it is, whatever its length.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.llm.common import partitions, prepare, stored

FANOUT = 8
BLOCK_LEVELS = 4                       # aligned blocks of 8 ** 4 nodes

NODE_SCHEMA = "tree string, pos long, size long, digest binary"
PATH_SCHEMA = "tree string, pos long, digest binary, lefts array<string>, rights array<string>, root string"
VERSION_SCHEMA = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                  "folded_root string, verified boolean, copied array<string>")


def digest_of(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def tree_levels(nodes: int) -> int:
    """Levels of hashing until one node remains."""
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        levels += 1
    return levels


def fold(digest: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a digest and the siblings on its way up lead to."""
    for left, right in siblings:
        digest = digest_of(left + digest + right)
    return digest


class PathCopyTree:
    """A persistent tree over one block.  Nodes are only ever added; a version is its root's number,
    and all versions stay readable."""

    def __init__(self, leaves: list[str], levels: int):
        self.digest = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        level = list(range(len(leaves)))
        for _ in range(levels):
            level = [self._node(tuple(level[a:a + FANOUT])) for a in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digest.append(digest_of("".join([self.digest[c] for c in children])))
        self.children.append(children)
        return len(self.digest) - 1

    def way(self, root: int, position: int) -> list[tuple[int, int]]:
        """(ancestor, number of the child taken) of a leaf, from its parent up to the root."""
        span, node, out = FANOUT ** self.levels, root, []
        for _ in range(self.levels):
            span //= FANOUT
            child, position = divmod(position, span)
            out.append((node, child))
            node = self.children[node][child]
        return out[::-1]

    def siblings(self, root: int, position: int) -> list[tuple[str, str]]:
        """Digests left and right of the way up, level by level."""
        out = []
        for node, child in self.way(root, position):
            run = [self.digest[c] for c in self.children[node]]
            out.append(("".join(run[:child]), "".join(run[child + 1:])))
        return out

    def replace(self, root: int, position: int, digest: str) -> tuple[int, list[int]]:
        """(version, copied nodes from the new leaf upwards) with another leaf at ``position``."""
        self.digest.append(digest)
        self.children.append(())
        copied = [len(self.digest) - 1]
        for node, child in self.way(root, position):
            run = self.children[node]
            copied.append(self._node(run[:child] + (copied[-1],) + run[child + 1:]))
        return copied[-1], copied


# ----------------------------------------------------------------------------- leaves
def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def every_third(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, tampered: Column, new_text: Column) -> DataFrame:
    """(tree, doc_id, uid, digest, changed): one row per document; ``changed`` is the leaf of a
    tampered row.  The key of a tree sorts like its language, null first."""
    lang = F.col("lang").cast("string")
    return docs.select(
        F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), lang)).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
        leaf_digest(F.col("text")).alias("digest"),
        F.when(tampered, leaf_digest(new_text)).alias("changed"))


def positioned(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos (0, 1, ... per tree in ``order``) and size (nodes of the tree).  A tree's
    rows are spread over ranges; only the ranges' row counts meet."""
    n = partitions(nodes.sparkSession)
    ranged = stored(nodes.repartitionByRange(n, "tree", *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"),
                            F.sum("rows").over(whole).alias("size"))
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)))
    return local.join(offsets, ["tree", "part"]).withColumn("pos", F.col("base") + F.col("at") - 1) \
        .drop("part", "at", "base")


# ----------------------------------------------------------------------------- levels
def _block_tree(group: pa.Table, depth: int) -> tuple[pa.Table, PathCopyTree]:
    group = group.sort_by("pos")
    levels = min(depth, tree_levels(group.column("size")[0].as_py()))
    return group, PathCopyTree([d.hex() for d in group.column("digest").to_pylist()], levels)


def in_blocks(nodes: DataFrame, depth: int, *more: str):
    """Nodes grouped by tree and aligned block of FANOUT ** depth positions."""
    block = F.expr(f"pos div {FANOUT ** depth}")
    return nodes.select("tree", "pos", "size", "digest", *more, block.alias("blk")).groupBy("tree", "blk")


def raised(nodes: DataFrame, depth: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Node tables from ``nodes`` up to the one in which every tree has a single node."""
    width = FANOUT ** depth

    def block_root(group: pa.Table) -> pa.Table:
        group, tree = _block_tree(group, depth)
        first = group.slice(0, 1)
        return pa.table({"tree": first.column("tree"), "pos": pa.array([first.column("pos")[0].as_py() // width]),
                         "size": pa.array([-(-first.column("size")[0].as_py() // width)]),
                         "digest": pa.array([bytes.fromhex(tree.digest[tree.root])], pa.binary())})
    tables = [nodes]
    while True:
        up = in_blocks(tables[-1], depth).applyInArrow(block_root, NODE_SCHEMA)
        tables.append(stored(up, "nodes"))
        if (tables[-1].agg(F.max("size")).first()[0] or 1) <= 1:
            return tables


def lowered(nodes: DataFrame, paths: DataFrame, depth: int = BLOCK_LEVELS) -> DataFrame:
    """The siblings up to the root of every node, from those of its block."""
    def extend(block: pa.Table, above: pa.Table) -> pa.Table:
        block, tree = _block_tree(block, depth)
        lefts, rights = above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()
        n = block.num_rows
        ways = [tree.siblings(tree.root, i) for i in range(n)]
        return pa.table({
            "tree": block.column("tree"), "pos": block.column("pos"), "digest": block.column("digest"),
            "lefts": pa.array([[x for x, _ in w] + lefts for w in ways], pa.list_(pa.string())),
            "rights": pa.array([[x for _, x in w] + rights for w in ways], pa.list_(pa.string())),
            "root": pa.array([above.column("root")[0].as_py()] * n, pa.string())})
    both = in_blocks(nodes, depth).cogroup(paths.groupBy("tree", "pos"))
    return stored(both.applyInArrow(extend, PATH_SCHEMA), "paths")


def manifest(rows: DataFrame, depth: int = BLOCK_LEVELS) -> dict:
    """The levels of a dataset's tree over positioned leaves: ``trees`` (node tables of the
    languages' trees, leaves first), ``top`` (those of the tree over the subroots) and ``blocks``
    (per block of leaves: the siblings of its ancestors, subroot and root)."""
    trees = raised(rows, depth)
    none = F.array().cast("array<string>")
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    named = stored(positioned(subroots, ["lang"]), "subroots")
    top = raised(named, depth)
    paths = top[-1].select("tree", "pos", "digest", none.alias("lefts"), none.alias("rights"),
                           F.lower(F.hex("digest")).alias("root"))
    for nodes in reversed(top[:-1]):
        paths = lowered(nodes, paths, depth)
    names = named.select(F.col("lang"), "pos")
    paths = paths.drop("tree").join(names, "pos").select(
        F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "lefts", "rights", "root")
    subs = paths.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    for nodes in reversed(trees[1:-1]):
        paths = lowered(nodes, paths, depth)
    return {"trees": trees, "top": top, "blocks": paths, "subroots": subs}


# ----------------------------------------------------------------------------- versions
def versions(docs: DataFrame, tampered: Column, new_text: Column, copies: bool = False,
             depth: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: its leaf and proof in the untampered tree and the root that is folded
    from its tampered (else original) leaf.  ``copies`` fills ``copied`` with the digests of the
    nodes a version adds, from the leaf to the root; all its other nodes are shared."""
    prepare(docs.sparkSession)
    rows = stored(positioned(stored(leaves(docs, tampered, new_text), "leaves"), ["doc_id", "digest", "uid"]), "rows")
    tree = manifest(rows, depth)

    def verify(block: pa.Table, above: pa.Table) -> pa.Table:
        block, tree = _block_tree(block, depth)
        upper = list(zip(above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()))
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        changed = block.column("changed").to_pylist()
        proof, folded, copied = [], [], []
        for i, new in enumerate(changed):
            inner = tree.siblings(tree.root, i)
            proof.append(digest_of("".join([left + right for left, right in inner + upper])))
            if new is None:
                folded.append(fold(tree.digest[i], inner + upper))
                copied.append(None)
                continue
            version, nodes = tree.replace(tree.root, i, new.hex())
            way = [tree.digest[x] for x in nodes]
            for left, right in upper:                  # the version goes on above its block
                way.append(digest_of(left + way[-1] + right))
            folded.append(way[-1])
            copied.append(way if copies else None)
        n = block.num_rows
        return pa.table({
            "doc_id": block.column("doc_id"), "leaf": pa.array(tree.digest[:n], pa.string()),
            "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
            "copied": pa.array(copied, pa.list_(pa.string()))})

    above = tree["blocks"].select("tree", "pos", "lefts", "rights", "root").join(tree["subroots"], "tree")
    return in_blocks(rows, depth, "doc_id", "changed").cogroup(above.groupBy("tree", "pos")) \
        .applyInArrow(verify, VERSION_SCHEMA)


def tamper_report(docs: DataFrame) -> DataFrame:
    """Versions in which every row whose crc32 of the decimal doc_id is divisible by 3 has its text
    lower-cased (A-Z)."""
    return versions(docs, every_third(F.col("doc_id")), lower_ascii(F.col("text"))).drop("copied")
