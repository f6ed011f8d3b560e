import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from opsdesk.llm import textscan as S

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nab'éß1—", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    data, off = S.text_bytes(pa.array(texts, pa.string()))
    for table, pattern in ((S.SPACE_WORDS, rb"[^\x20\x09-\x0D]+"), (S.ALNUM_WORDS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, first = S.words(data, off, table)
        for d, text in enumerate(texts):
            got = [data[a:b].tobytes() for a, b in zip(starts[first[d]:first[d + 1]], ends[first[d]:first[d + 1]])]
            assert got == re.findall(pattern, (text or "").encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=6), st.integers(1, 4), st.integers(4, 12))
def test_anchors_partition_windows_by_content(docs, k, window):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    flat = np.array([x for d in docs for x in d], np.int64)
    prefix = S.prefix_hash(flat.astype(np.uint64) + np.uint64(7))
    order = S.gram_hash(prefix, k)
    at, lo, hi = S.window_anchors(order, first, k, window)
    seen = [w for a, b in zip(lo, hi) for w in range(a, b + 1)]
    want = [w for d in range(len(docs)) for w in range(first[d], first[d + 1] - window + 1)]
    assert sorted(seen) == want
    by_content = {}
    for p, a, b in zip(at, lo, hi):
        for w in range(a, b + 1):
            assert w <= p <= w + window - k
            content = tuple(flat[w:w + window])
            assert by_content.setdefault(content, p - w) == p - w


def test_hashes_depend_on_content_only():
    a = S.prefix_hash(np.array([5, 1, 2, 3, 9, 1, 2, 3], np.uint64))
    h = S.range_hash(a, np.array([1, 5, 0]), np.array([4, 8, 3]))
    assert h[0] == h[1] != h[2]
