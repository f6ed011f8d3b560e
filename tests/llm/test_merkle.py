import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from opsdesk.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, per node the digests beside its way up)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 8 * 8:a // 8 * 8 + 8]
            ways[i].append((run[:a % 8], run[a % 8 + 1:]))
        nodes = [h(*nodes[a:a + 8]) for a in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    low = {65 + i: 97 + i for i in range(26)}
    keyed = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r)), r) for r in rows)
    trees = [[(k[-1], r) for k, r in g] for _, g in groupby(keyed, key=lambda x: x[0][:2])]
    climbed = [climb([x for x, _ in t]) for t in trees]
    root, tops = climb([s for s, _ in climbed])
    out = []
    for t, (subroot, ways), top in zip(trees, climbed, tops):
        for (x, r), way in zip(t, ways):
            proof = h(*(d for left, right in way + top for d in left + right))
            f = x
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                f = leaf(*r[:4], None if r[4] is None else r[4].translate(low))
            for left, right in way + top:
                f = h(*left, f, *right)
            out.append((r[0], x, subroot, root, proof, f, f == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [(i, f"s{i % 3}", ["en", "Ünd", None, "", "-"][i * i % 5], None if i % 7 == 0 else i, f"Text {i} ÀB") for i in range(1, 120)]
ROWS += [(5, "s2", "en", 5, "Text 5 ÀB")] * 3 + [(5, None, "en", 5, "other 5"), (None, "s", "en", 1, "No Id"), (None, None, None, None, None)]
ROWS += [(200, "s", "lone", 3, None), (201, "s", "en", 0, ""), (202, "s", "en", 300_000, "Long Text " * 30_000), (203, "s", "xx", 1, None)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_versions_equal_brute_force(spark, depth):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "size", "tree", "digest", "uid", "blk", "root")})
    got = merkle.versions(docs.repartition(5), merkle.every_third(F.col("doc_id")), merkle.lower_ascii(F.col("text")), depth=depth)
    assert sorted((tuple(r) for r in got.drop("copied").collect()), key=str) == brute(ROWS)


def test_empty_table_and_a_single_row(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert merkle.tamper_report(docs.where("doc_id < 0")).count() == 0
    one = merkle.tamper_report(docs.where("doc_id = 200")).collect()
    assert [tuple(r) for r in one] == brute([r for r in ROWS if r[0] == 200])
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == h()


def test_a_version_copies_its_ancestors_only(spark):
    leaves = [h(str(i)) for i in range(70)]
    tree = merkle.PathCopyTree(leaves, merkle.tree_levels(len(leaves)))
    before = list(tree.digest)
    version, copied = tree.replace(tree.root, 65, h("new"))
    assert len(copied) == 1 + tree.levels == 4 and len(tree.digest) == len(before) + 4
    assert tree.digest[:len(before)] == before and tree.digest[version] == climb(leaves[:65] + [h("new")] + leaves[66:])[0]
    assert tree.children[version][0] == tree.children[tree.root][0]            # shared, not copied
    second, _ = tree.replace(version, 0, h("more"))
    assert tree.digest[second] == climb([h("more")] + leaves[1:65] + [h("new")] + leaves[66:])[0]
    assert merkle.fold(h("new"), tree.siblings(tree.root, 65)) == tree.digest[version]


def test_copies_are_the_nodes_of_the_way(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(100)]
    got = merkle.versions(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 77, F.lit("new"), copies=True, depth=1).collect()
    for r in got:
        assert (r.copied is None) == (r.doc_id != 77)
    version = next(r for r in got if r.doc_id == 77)
    assert version.copied[0] == leaf(77, "s", "en", 77, "new") and len(version.copied) == 4
    assert version.copied[-1] == version.folded_root == climb([leaf(*(r[:4]), "new" if r[0] == 77 else r[4]) for r in rows])[0]
