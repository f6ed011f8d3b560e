import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from opsdesk.llm import tokens

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
PATTERN = public_tokenizers.PATTERN


def test_line_counts_sum_to_the_document(spark, make_docs, words):
    rows = [(1, None), (2, ""), (3, "a\n\n\n  b\nc"), (3, "\n"), (None, "ß 日本語\n😀 x"), (4, "\n".join(" ".join(words(9, i)) for i in range(3000)))]
    got = tokens.token_counts(make_docs(rows), RANKS, PATTERN).collect()
    enc = tokens.ByteBpe(RANKS, PATTERN).enc
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i in (1, 2):
        assert [tuple(r) for r in by_doc[i]] == [(i, 0, 0, 0, 0, 0)]
    for i in (None, 4):
        text = dict(rows)[i]
        parts = sorted(by_doc[i], key=lambda r: r.section)
        assert sum(r.n_tokens for r in parts) == len(enc.encode_ordinary(text))
        assert [text[r.start:r.start + r.n_chars] for r in parts] == text.splitlines(keepends=True)
    assert sum(r.n_tokens for r in by_doc[3]) == len(enc.encode_ordinary("a\n\n\n  b\nc")) + len(enc.encode_ordinary("\n"))


def test_allocation_rules():
    t0, t1 = np.array([0, 3, 9, 12, 20]), np.array([3, 9, 12, 20, 22])
    s0, s1 = np.array([0, 5, 15]), np.array([5, 10, 18])
    for rule, want in (("largest", [0, 1, 1, 2, 2]), ("first", [0, 0, 1, 2, 2]), ("last", [0, 1, 1, 2, 2])):
        where, crosses = tokens.allocate(t0, t1, s0, s1, rule)
        assert where.tolist() == want
        assert crosses.tolist() == [False, True, False, False, False]


def test_largest_overlap_ties_go_to_the_earlier():
    where, crosses = tokens.allocate(np.array([2]), np.array([6]), np.array([0, 4]), np.array([4, 8]))
    assert where.tolist() == [0] and crosses.tolist() == [True]


def test_given_sections(spark, make_docs):
    docs = make_docs([(1, "Hello wonderful world"), (2, "x")]).withColumn(
        "parts", F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 0, 'end', 8), named_struct('start', 8, 'end', 21))")))
    got = {r.section: r for r in tokens.token_counts(docs, RANKS, PATTERN, sections="parts").collect()}
    enc = tokens.ByteBpe(RANKS, PATTERN).enc
    assert len(got) == 2 and got[0].n_tokens + got[1].n_tokens == len(enc.encode_ordinary("Hello wonderful world"))
    assert got[0].n_crossing + got[1].n_crossing == 1           # " wonderful" lies over the boundary


def test_empty_table(spark, make_docs):
    assert tokens.token_counts(make_docs([(1, "x")]).where("doc_id = 2"), RANKS, PATTERN).count() == 0
