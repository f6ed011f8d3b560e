import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsdesk.llm import phrases

LOW = {65 + i: 97 + i for i in range(26)}


def brute(rows, support, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    most = defaultdict(int)
    for p, a in found.items():
        w = p[1:]
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                most[(p[0], *w[i:i + m])] = max(most[(p[0], *w[i:i + m])], a)
    ranked = defaultdict(list)
    for p, a in found.items():
        if 100 * most[p] < 80 * a:
            cuts = [(2_000_000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            ranked[p[0]].append((-score, -a, " ".join(p[1:]).encode(), a, f[p[:k]], f[(p[0], *p[k:])]))
    return sorted((lang, i, p.decode(), a, l, r, n[lang], -s) for lang, v in ranked.items()
                  for i, (s, _, p, a, l, r) in enumerate(sorted(v)[:top], 1))


def texts(seed, count, vocabulary):
    rng = random.Random(seed)
    for i in range(count):
        words = [rng.choice(vocabulary)[:rng.randrange(1, 3)] for _ in range(rng.randrange(0, 40))]
        yield "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)


ROWS = [(["en", "en", "en", "es", None, "und", ""][i % 7], t) for i, t in
        enumerate(texts(1, 400, ["ab", "AB", "cd", "en", "es", "ü", "Äx", "x y", "'"]))]
ROWS += [("en", None), ("en", ""), (None, None), ("xx", "only once"), ("en", ".,;:!?"), ("en", "one " * 3000), ("en", "a b. c d " * 200)]
ROWS += [("dup", "the same line of words. the same line")] * 40


def made(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit("x") for c in ("phrase", "words", "n", "grp", "h", "k", "l", "r", "salt", "doc_id")})


@pytest.mark.parametrize("support,shard_bytes,top", [(30, 1 << 26, 2000), (5, 600, 40), (2, 5000, 2000)])
def test_collocations_equal_brute_force(spark, support, shard_bytes, top):
    got = phrases.collocations(made(spark, ROWS).repartition(4), support, top, shard_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, support, top)


def test_empty_table(spark):
    assert phrases.collocations(made(spark, ROWS).where("lang = 'none'")).count() == 0


def test_local_supports_miss_nothing():
    """Whatever the shards hold, what they report and may leave unreported reaches the total."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = rng.integers(1, 1000, rng.integers(1, 40))
        local = rng.integers(0, 40, len(size))
        support = max(1, int(local.sum()))
        least = np.maximum(1, -(-support * size // (phrases.LOWERED * int(size.sum()))))
        reported = int((local - least + 1)[local >= least].sum())
        assert reported + support // phrases.LOWERED >= local.sum()
        if local.sum():
            assert (local >= least).any()


def test_a_word_spelled_like_its_language_is_its_own(spark):
    rows = [("en", "en de es")] * 3 + [("es", "es de en")] * 2 + [("de", "de de")]
    assert sorted(tuple(r) for r in phrases.collocations(made(spark, rows), 1, 50, 10).collect()) == brute(rows, 1, 50)


def test_products_beyond_64_bits(spark):
    """The score's arithmetic on counts of 10**13 and more."""
    score = spark.sql("SELECT cast(2000000 AS decimal(7, 0)) * cast(90000000000001L AS decimal(20, 0)) "
                      "div (cast(90000000000002L AS decimal(20, 0)) + cast(180000000000007L AS decimal(20, 0))) AS s").first().s
    assert score == 2_000_000 * 90000000000001 // (90000000000002 + 180000000000007)
