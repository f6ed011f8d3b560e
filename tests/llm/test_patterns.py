import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsdesk.llm import patterns
from test_packing import SPEC, bpe, ids_of  # noqa: F401  (fixture)


def check(got, rows, whole, capacity=2048):
    """Exact pieces, and sequences without gaps, overlaps or overflow; the number of sequences."""
    want = sorted(((i, a // capacity, a, min(capacity, len(x) - a), zlib.crc32(x[a:a + capacity].tobytes()))
                   for (i, _), x in zip(rows, whole) for a in range(0, len(x), capacity)), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in fill.values())
    return len(fill)


def test_pieces_are_exact_and_fit(spark, make_docs, words, bpe):  # noqa: F811
    rows = [(1, None), (2, ""), (3, "hello World"), (3, "hello World"), (None, "x y"), (None, "x y"), (4, " ".join(words(9000, 1)))]
    rows += [(i, " ".join(words(i * 37 % 900 + 1, i))) for i in range(10, 160)] + [(500 + i, "same text") for i in range(60)]
    whole = [np.array([*ids, 0], "<u4") for ids in ids_of(bpe, [t for _, t in rows])]
    got = patterns.pack_by_patterns(make_docs(rows).repartition(6), SPEC).collect()
    used = check(got, rows, whole)
    sizes = [min(2048, len(x) - a) for x in whole for a in range(0, len(x), 2048)]
    assert used <= 1.02 * plain_best_fit(sizes, 2048)      # few pieces of many lengths: the fit's hardest case


def test_a_length_of_exactly_one_sequence(spark, make_docs, bpe):  # noqa: F811
    rows = [(i, " ".join(["a"] * n)) for i, n in enumerate([2046, 2047, 2048, 4095, 4096])]
    whole = [np.array([*ids, 0], "<u4") for ids in ids_of(bpe, [t for _, t in rows])]
    assert [len(x) for x in whole] == [2047, 2048, 2049, 4096, 4097]
    check(patterns.pack_by_patterns(make_docs(rows), SPEC).collect(), rows, whole)


def test_empty_table(spark, make_docs):
    assert patterns.pack_by_patterns(make_docs([(1, "x")]).where("doc_id = 2"), SPEC).count() == 0


def plain_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_every_piece_has_its_own_place(sizes):
    counts = np.bincount(sizes, minlength=65).astype(np.int64)
    plan = patterns.Plan(counts)
    taken = set()
    for size in range(1, 65):
        sequence, offset = plan.place(np.full(counts[size], size), np.arange(counts[size]))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            cells = {(s, x) for x in range(o, o + size)}
            assert o + size <= 64 and not cells & taken
            taken |= cells
    assert len({s for s, _ in taken}) == plan.sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150))
def test_grouped_best_fit_equals_one_by_one(sizes):
    counts = np.bincount(sizes, minlength=41).astype(np.int64)
    groups = patterns.best_fit_decreasing(counts)
    assert sum(n for _, n in groups) == plain_best_fit(sizes, 40)
    used = np.zeros(41, np.int64)
    for parts, n in groups:
        for size, times in parts:
            used[size] += n * times
    assert (used == counts).all()


def test_patterns_are_all_exact_fillings():
    present = np.ones(31, bool)
    got = {tuple(sorted(x for x in row if x)) for row in patterns.enumerate_patterns(present).tolist()}
    want = {(30,)} | {(a, 30 - a) for a in range(1, 16)}
    want |= {(a, b, 30 - a - b) for a in range(1, 11) for b in range(a, 30) if 30 - a - b >= b}
    assert got == want
    present[7] = False
    assert all(7 not in row for row in patterns.enumerate_patterns(present).tolist())


def test_fit_finds_the_repeats_that_made_the_histogram():
    rng = np.random.default_rng(3)
    counts = np.zeros(257, np.int64)
    for _ in range(4000):
        a = rng.integers(20, 120)
        b = rng.integers(20, 120)
        counts[[a, b, 256 - a - b]] += 1
    plan = patterns.Plan(counts)
    assert plan.sequences <= -(-int((counts * np.arange(257)).sum()) // 256) + 3
    assert plan.fitted > 0.8 * plan.sequences
