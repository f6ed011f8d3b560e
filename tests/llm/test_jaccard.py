import random

import pytest

import brute
from opsdesk.llm import components as graph
from opsdesk.llm import jaccard


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(2)
    out = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one two"), (6, "one two three four five"), (7, "two one")]
    base = words(200, 1)
    for i in range(10, 130):                               # a large group of near copies
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{i}"
        out.append((i, " ".join(w)))
    out += [(i, " ".join(base)) for i in range(130, 150)]  # exact copies
    for i in range(150, 170):                              # a chain around the threshold
        out.append((i, " ".join(words(100, 7)[(i - 150) * 2:] + words(60, 8)[:(i - 150) * 2])))
    out += [(i, " ".join(words(80, i))) for i in range(200, 220)]
    out.append((300, " ".join(words(20_000, 300))))
    out.append((301, " ".join(words(20_000, 300)[:-500])))
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_classes_and_links_equal_brute_force(spark, make_docs, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    got = jaccard.near_duplicates(make_docs(rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute.jaccard_classes(rows)


def test_repeated_and_null_ids(spark, make_docs, words):
    text = " ".join(words(50, 1))
    rows = [(1, text), (1, text), (1, " ".join(words(50, 2))), (None, text), (None, " ".join(words(50, 3))), (2, None)]
    got = jaccard.near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_links) for r in got if r.n_links) == [(False, 1, 2), (False, 1, 2), (True, None, 2)]
    kept = jaccard.one_of_each_class(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, text), (1, rows[2][1]), (None, rows[4][1]), (2, None)], key=str)


def test_one_of_each_class(spark, make_docs, rows):
    kept = sorted(r.doc_id for r in jaccard.one_of_each_class(make_docs(rows)).collect())
    assert kept == sorted({c for _, c, _ in brute.jaccard_classes(rows)})


def test_needed_matches_follow_the_posterior():
    need = jaccard.needed_matches(0.8)
    assert need == sorted(need) and need[-1] < 0.8 * jaccard.HASHES
    assert jaccard.needed_matches(0.8, tolerance=1e-3)[-1] > need[-1]


@pytest.mark.parametrize("size", [1 << 20, 10])
def test_components(spark, size, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", size)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark, make_docs):
    assert jaccard.near_duplicates(make_docs([(1, "x")]).where("doc_id = 2")).count() == 0


def test_rows_of_one_id_are_joined_by_content(spark, make_docs, words, monkeypatch):
    """Near copies without an id and of one id: every set meets its own text only."""
    own, joined = jaccard.map_pieces, []

    def counted(df, *args):
        if "cluster" in df.columns:
            joined.append(df.count())
        return own(df, *args)

    monkeypatch.setattr(jaccard, "map_pieces", counted)
    body = words(100, 9)
    rows = [(i, " ".join([*body, f"end{j}{i}"])) for i in (None, 5) for j in range(40)]
    got = jaccard.near_duplicates(make_docs(rows)).collect()
    assert len(got) == 80 and all(r.n_links == 79 for r in got) and {r.class_id for r in got} == {5}
    assert joined == [80]
