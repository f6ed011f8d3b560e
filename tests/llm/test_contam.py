import pytest

import brute
from opsdesk.llm import contam


@pytest.fixture(scope="module")
def items(words):
    return [(1, " ".join(words(30, 1))), (2, " ".join(words(30, 1)[5:20])), (3, "Tiny item"), (4, "one"), (5, None), (6, ""),
            (None, "null id item"), (7, " ".join(words(12, 2))), (8, " ".join(words(12, 2))), (9, "Ünïcode, wörds-here!"),
            (10, "a b a b a b a b a b a b")]


@pytest.fixture(scope="module")
def rows(words):
    w = words(30, 1)
    return [(1, None), (2, ""), (3, " ".join(words(20, 50) + w[3:16] + words(5, 51))), (4, " ".join(w[:9])),
            (5, "This is a TINY  item, one more"), (6, "tiny"), (7, " ".join(w) + "... " + " ".join(words(12, 2))),
            (7, "one one"), (None, " ".join(w)), (8, "ÜnÏcode ünïcode wörds here"), (9, "null id item"),
            (10, "a b " * 30), (11, " ".join(words(30_000, 9) + w))]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_hits_equal_brute_force(spark, make_docs, rows, items, block, monkeypatch):
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contam.find_contamination, "__defaults__", (10, block, None, False))
    got = contam.contamination_report(make_docs(rows), table)
    assert sorted(map(tuple, got.collect()), key=str) == brute.item_hits(rows, items)


def test_decontaminate(spark, make_docs, items, words):
    table = spark.createDataFrame(items, "item_id long, text string")
    w, clean = words(30, 1), " ".join(words(60, 77))
    docs = make_docs([(1, clean), (2, clean + " " + " ".join(w[:12])), (3, " ".join(w)), (4, None)])
    assert contam.decontaminate(docs, table).columns == docs.columns
    got = {r.doc_id: r.text for r in contam.decontaminate(docs, table).collect()}
    assert got[1] == clean and got[2].split() == clean.split() and 3 not in got and got[4] is None


def test_empty_tables(spark, make_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contam.contamination_report(make_docs([(1, "a b c")]), none).collect()] == [(1, 3, 0, 0)]
    assert contam.contamination_report(make_docs([(1, "x")]).where("doc_id = 2"), none).count() == 0


def test_longest_matches():
    index = contam.ItemIndex([(1, [b"a", b"b", b"c", b"d"]), (2, [b"b", b"c", b"x"])], 3)
    code = {w: i for i, w in enumerate(sorted([b"a", b"b", b"c", b"d", b"x"], key=lambda w: int(
        contam.S.range_hash(contam.S.prefix_hash(contam.S.BYTE_CODE[contam.np.frombuffer(w, "u1")]),
                            contam.np.array([0]), contam.np.array([len(w)]))[0])))}
    state, match = contam.np.zeros(1, int), contam.np.zeros(1, int)
    got = []
    for w in [b"a", b"b", b"c", b"x", b"d", b"b", b"c", b"d"]:
        index.step(state, match, contam.np.array([code[w]]))
        got.append(int(match[0]))
    assert got == [1, 2, 3, 3, 1, 1, 2, 3]
