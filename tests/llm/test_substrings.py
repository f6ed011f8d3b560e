import random

import numpy as np
import pytest

import brute
from opsdesk.llm import fmindex, repeats, suffixblocks


def segments(seed, letters, window, tail):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + letters, 300).astype(np.uint8)
    segs, wins, docs = [], [], []
    for _ in range(40):
        a, n = int(rng.integers(0, 200)), int(rng.integers(window, window + tail))
        s = base[a:a + n].copy()
        if rng.random() < 0.4:
            s[rng.integers(0, len(s))] = 97
        if rng.random() < 0.1:
            s[:] = 97
        segs.append(s)
        wins.append(int(rng.integers(1, len(s) - window + 2)))
        docs.append(int(rng.integers(0, 1000)))
    end = np.cumsum([len(s) for s in segs])
    low = {}
    for s, w, d in zip(segs, wins, docs):
        for j in range(w):
            k = s[j:j + window].tobytes()
            low[k] = min(low.get(k, d), d)
    want = np.array([low[s[j:j + window].tobytes()] for s, w in zip(segs, wins) for j in range(w)])
    return np.concatenate(segs), end - [len(s) for s in segs], end, np.array(wins), np.array(docs), want


@pytest.mark.parametrize("letters", [2, 4, 26])
@pytest.mark.parametrize("bucket", [50, 1 << 20])
def test_suffix_blocks_equal_brute_force(letters, bucket, monkeypatch):
    monkeypatch.setattr(suffixblocks, "BUCKET", bucket)
    for seed in range(5):
        *args, want = segments(seed, letters, 50, 50)
        assert (suffixblocks.smallest_docs(*args) == want).all()


def test_cover_reaches_every_pair():
    assert suffixblocks.SHIFT.min() >= 0 and suffixblocks.SHIFT.max() < suffixblocks.PERIOD


def test_matching_statistics_of_foreign_text():
    rng = np.random.default_rng(3)
    for _ in range(10):
        seqs = [rng.integers(1, 4, rng.integers(5, 30)) for _ in range(6)]
        end = np.cumsum([len(s) for s in seqs])
        index = fmindex.FmIndex(np.concatenate(seqs), end - [len(s) for s in seqs], end, 5, 40)
        query = rng.integers(1, 6, 80)
        query[query == 5] = -1                            # unknown to the index
        got = np.zeros(80, int)
        index.matching(query, np.array([0, 30]), np.array([30, 80]), lambda lane, at, lo, m: got.__setitem__(at, m))
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for a, b in ((0, 30), (30, 80)):
            for i in range(a, b):
                m = 0
                while i + m < b and tuple(query[i:i + m + 1]) in subs:
                    m += 1
                assert got[i] == m


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 1000)
    tree = fmindex.WaveletMatrix(seq, 37)
    c, i = rng.integers(0, 37, 300), rng.integers(0, 1001, 300)
    assert (tree.rank(c, i) == [(seq[:b] == a).sum() for a, b in zip(c, i)]).all()


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(5)
    shared = " ".join(words(70, 1))
    hot = " ".join(words(55, 2))
    out = [(1, None), (2, ""), (3, "short text"), (None, shared), (4, shared), (4, shared), (5, shared + " x y"),
           (6, "é " * 120), (7, "é " * 90), (8, "\t".join(words(80, 3)) + "\x1c z"), (9, "\n ".join(words(80, 3)))]
    for i in range(10, 60):                                # a hot passage in most documents
        own = words(rng.randrange(0, 60), i)
        out.append((i, " ".join(own) + " " + hot + " " + " ".join(words(20, 900 + i))))
    out += [(i, "aaaa" * 40) for i in range(60, 64)]
    out.append((70, " ".join(words(20_000, 70)) + " " + shared))    # very long
    return out


def test_words_equal_brute_force(spark, make_docs, rows):
    got = fmindex.remove_repeated_words(make_docs(rows))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute.words_removed(rows)


def test_bytes_equal_brute_force(spark, make_docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    got = suffixblocks.remove_repeated_bytes(make_docs(rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute.bytes_removed(rows)


def test_texts_and_spans(spark, make_docs, words):
    shared = " ".join(words(60, 4))
    docs = make_docs([(1, shared), (2, "left " + shared + " right")])
    texts = {r.doc_id: r.text for r in fmindex.remove_repeated_words(docs, emit_text=True).collect()}
    assert texts == {1: shared, 2: "left right"}
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans]
             for r in suffixblocks.remove_repeated_bytes(docs, emit_spans=True).collect()}
    assert spans == {1: [], 2: [(5, 5 + len(shared))]}


def test_empty_table(spark, make_docs):
    docs = make_docs([(1, "x")]).where("doc_id = 2")
    assert fmindex.remove_repeated_words(docs).count() == 0
    assert suffixblocks.remove_repeated_bytes(docs).count() == 0


@pytest.mark.parametrize("size", [1, 3000])
def test_hot_anchors_dealt_out_equal_brute_force(spark, make_docs, rows, monkeypatch, size):
    monkeypatch.setattr(repeats, "HOT_BYTES", size, raising=False)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    got = fmindex.remove_repeated_words(make_docs(rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute.words_removed(rows)
    got = suffixblocks.remove_repeated_bytes(make_docs(rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute.bytes_removed(rows)


@pytest.mark.parametrize("unit, window, k, engine", [("word", 50, 8, fmindex.smallest_docs), ("byte", 50, 16, suffixblocks.smallest_docs)])
def test_no_shard_holds_a_hot_anchor(spark, make_docs, words, monkeypatch, unit, window, k, engine):
    """A template phrase between each document's own words gives one distinct segment a document."""
    monkeypatch.setattr(repeats, "HOT_BYTES", 20 * window * 9, raising=False)
    phrase = " ".join(words(12, 77))
    dealt, shards = repeats.layout(make_docs([(i, " ".join([*words(60, 100 + i, 10**9), phrase, *words(60, 5000 + i, 10**9)]))
                                              for i in range(600)]))

    def bounded(text, a, b, wins, doc):
        if len(a) > 400:
            raise RuntimeError(f"{len(a)} segments in one shard")
        return engine(text, a, b, wins, doc, window)

    repeats.repeated_ranges(dealt, shards, unit, window, k, bounded).collect()
