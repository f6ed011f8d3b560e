import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsdesk.llm import linealign


def brute(rows, min_block=linealign.MIN_BLOCK):
    """Every text aligned with all earlier ones, lines compared as text."""
    seqs = {}
    for i, t in rows:
        if i is not None and t is not None:
            s = tuple(x.strip(" ") for x in t.split("\n"))
            seqs[s] = min(seqs.get(s, i), i)
    cut = {}
    for s, doc in seqs.items():
        gone = set()
        for early, first in seqs.items():
            if (first, early) < (doc, s) and set(early) & set(s):
                gone |= set(linealign.deleted_lines(list(early), list(s), [len(y) for y in s], min_block))
        cut[s] = gone
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        lines = t.split("\n")
        s = tuple(x.strip(" ") for x in lines)
        gone = set() if i is None else set(range(len(lines))) if i > seqs[s] else cut[s]
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(words):
    def line(seed):
        return " ".join(words(8, seed))
    body = [line(i) for i in range(30)]
    out = [(1, None), (2, ""), (3, "\n\n"), (4, "\n".join(body)), (5, "\n".join(body)), (5, "\n".join(body)),
           (6, "\n".join(["head line of this one here", *body[5:15], "  " + body[16] + " ", "tail"])),
           (7, "\n".join([line(100), body[29], line(101)])), (None, "\n".join(body)), (8, body[3]),
           (9, "\n".join(line(200 + i % 3) for i in range(3000)))]
    boiler = "this boilerplate line stands in very many documents"
    for i in range(20, 100):                               # a long line in many documents
        out.append((i, "\n".join([line(1000 + i), boiler, line(2000 + i), line(3000 + i)])))
    copies = [line(5000 + j) for j in range(10)]
    for i in range(200, 280):                              # near copies: every line is frequent
        out.append((i, "\n".join([*copies[:i % 10], line(6000 + i), *copies[i % 10:]])))
    return out


def test_operator_equals_brute_force(spark, make_docs, rows):
    got = linealign.remove_repeated_lines(make_docs(rows)).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_what_goes_and_what_stays(spark, make_docs, rows):
    got = {r.doc_id: r for r in linealign.remove_repeated_lines(make_docs(rows)).collect()}
    assert got[4].n_removed == 0 and got[5].n_removed == 30 and got[5].text == ""
    assert got[6].n_removed == 11 and got[7].n_removed == 1
    assert got[20].n_removed == 0 and all(got[i].n_removed == 1 for i in range(21, 100))
    assert all(got[i].n_removed >= 8 for i in range(201, 280))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=20), st.lists(st.integers(0, 6), max_size=20))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = linealign.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_patience_keeps_unique_lines_in_order():
    a, b = [1, 2, 3, 9, 4, 5, 6], [1, 2, 3, 8, 8, 4, 5, 7, 6]
    assert [a[i] for i, _ in linealign.patience(a, b)] == [1, 2, 3, 4, 5, 6]


def test_empty_table(spark, make_docs):
    assert linealign.remove_repeated_lines(make_docs([(1, "x")]).where("doc_id = 2")).count() == 0


def removed(make_docs, rows):
    return {r.doc_id: r.n_removed for r in linealign.remove_repeated_lines(make_docs(rows)).collect()}


def test_block_with_many_holders_goes(spark, make_docs, words):
    block = [" ".join(words(8, 7000 + j)) for j in range(3)]
    short = [f"short line {j}" for j in range(12)]
    rows = [(i, "\n".join([*(f"own line {i} {j} of this document" for j in range(9)), *block, f"end of {i}"])) for i in range(70)]
    rows += [(i, "\n".join([*short[:i % 12], f"variant {i}", *short[i % 12:]])) for i in range(100, 170)]
    got = removed(make_docs, rows)
    assert got[0] == 0 and all(got[i] == 3 for i in range(1, 70))
    assert got[100] == 0 and all(got[i] >= 8 for i in range(101, 170))

def test_block_of_stray_lines_goes(spark, make_docs):
    """Every line of the block also stands alone in an earlier document."""
    line = [f"line {j:02d} of the common passage" for j in range(30)]
    rows = [(j, f"start {j}\n{line[j]}\nend {j}") for j in range(30)]
    rows += [(100, "\n".join(["head of C", *line])), (101, "\n".join(["head of D", *line, "tail of D"]))]
    rows += [(200, "a long line that also stands in another text, alone"),
             (201, "\n".join(["other", "a short one", "a long line that also stands in another text, alone", "the next"])),
             (202, "\n".join(["a short one", "a long line that also stands in another text, alone", "the next", "more"]))]
    got = removed(make_docs, rows)
    assert got[100] == 0 and got[101] == 30 and got[202] == 3


def test_star_equals_all_pairs(spark, make_docs):
    """Texts cut in order from common ones: the star removes what aligning with every earlier text does."""
    import random
    rng = random.Random(5)
    base = [[f"text {b} line {j} {'x' * rng.randrange(20)}" for j in range(40)] for b in range(4)]
    rows = []
    for i in range(60):
        whole = base[rng.randrange(4)]
        a = rng.randrange(30)
        own = [x if rng.random() < 0.85 else f"changed {i} {j}" for j, x in enumerate(whole[a:a + rng.randrange(5, 30)])]
        rows.append((i, "\n".join([f"head {i}", *own])))
    texts = [t.split("\n") for _, t in rows]
    want = {}
    for i, late in enumerate(texts):
        gone = set()
        for early in texts[:i]:
            gone |= set(linealign.deleted_lines(early, late, [len(x) for x in late], linealign.MIN_BLOCK))
        want[i] = len(gone)
    assert removed(make_docs, rows) == want


def test_a_line_goes_however_many_hold_it(spark, make_docs, words):
    """The same result for few, 50, 51 and many holders of one long line."""
    for n in (2, 50, 51, 300):
        line = "one long line that stands in some documents of every size"
        rows = [(i, "\n".join([f"own line {i} a of it", f"own line {i} b of it", line, f"own line {i} c of it"])) for i in range(n)]
        assert removed(make_docs, rows) == {i: int(i > 0) for i in range(n)}


def test_repeated_lines_are_aligned_too(spark, make_docs, words):
    """Later copies of a text of three different lines, changed at both ends and in the middle."""
    table = [" ".join(words(8, 200 + i % 3)) for i in range(900)]
    late = ["other first line of the table", *table[1:400], "changed in the middle", *table[401:-1], "other last line of the table"]
    got = removed(make_docs, [(1, "\n".join(table)), (2, "\n".join(late))])
    assert got == {1: 0, 2: 897}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_subsequence_is_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    pairs = linealign.common_subsequence(a, b)
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_alignment_takes_time_in_proportion_to_the_lines():
    import time
    took = []
    for n in (20_000, 80_000):
        a = list(range(n))
        t = time.process_time()
        assert len(linealign.patience(a, a[:n // 2] + [-1] + a[n // 2 + 1:-1] + [-2])) == n - 2
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 1
