import random

import numpy as np
import pyarrow as pa
import pytest
from brute import SF_MORE

from opsdesk.llm import langid, toxicity
from opsdesk.llm.common import table


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF_MORE, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(i, "the cat and the dog went to the house with thirty others", "en") for i in range(1, 40)]
    rows += [(i, "der Hund und die Katze gehen über die Straße nach Hause", "de") for i in range(40, 80)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "123 ... 456", "en"), (93, "the dog", None), (94, "und über die Straße", None),
             (95, "日本語", None), (95, "the the", None), (None, "the house", None), (96, "—…", None)]
    docs = spark.createDataFrame([(i, t, g, "s", "x") for i, t, g in rows], "doc_id long, text string, lang string, score string, held_out string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (90, 91, 92, 96)] == ["und"] * 4 and by_id[90].score == 0
    assert by_id[93].lang_pred == "en" and by_id[94].lang_pred == "de" and by_id[95].lang_pred != "und"
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out


def test_language_mixture_is_found():
    langs = ["aa", "bb", "cc"]
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}

    def text(g, n):
        return " ".join("".join(rng.choice(letters[g]) for _ in range(5)) for _ in range(n))
    counts = np.ones((3, langid.BUCKETS))
    for k, g in enumerate(langs):
        data, off = langid.S.text_bytes(pa.array([text(g, 2000)]))
        counts[k] += np.bincount(langid.trigrams(data, off)[0], minlength=langid.BUCKETS)
    model = langid.Model(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
    data, off = langid.S.text_bytes(pa.array([text("aa", 50), text("bb", 30) + " " + text("cc", 60), ""]))
    pred, score, size = langid.infer(data, off, model)
    assert pred.tolist() == [0, 2, -1] and size.tolist() == [1, 2, 0]
    assert score[0] > 0.95 and abs(score[1] - 2 / 3) < 0.1


def test_language_without_training_rows(spark, make_docs):
    from pyspark.sql import functions as F
    docs = make_docs([(1, "some words"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und", "und"]
    assert langid.identify(docs.where("doc_id = 3")).count() == 0


@pytest.fixture(scope="module")
def sample(words):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        w = words(rng.randrange(5, 200), i, 400)
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vilebad", "vilesome", "vileous", "grimword"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_learns_stems_and_cases(spark, make_docs, sample):
    rows = [(i, t) for i, t, _ in sample] + [(900, None), (901, ""), (902, "vilenew w1 w2"), (902, "w1 w2 w3"), (None, "w5"),
                                             (903, " ".join(t for _, t, y in sample if not y))]
    labels = spark.createDataFrame([(i, y, 0, "x") for i, _, y in sample] + [(5, 0, 0, "x"), (7, None, 0, "x"), (9999, 1, 0, "x")],
                                   "doc_id long, toxic int, quality int, score string")
    got = toxicity.toxic_documents(make_docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in sample}
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    good = np.mean([a > b for y, a in held if y for z, b in held if not z])
    assert len(held) > 50 and good > 0.9
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score < 0.7


def test_toxicity_without_both_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxic_documents(docs, labels).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxic_documents(docs, one).collect()} == {1.0}


def test_toxicity_gradients():
    """Back-propagation equals finite differences."""
    rng = np.random.default_rng(0)
    w = toxicity.read_words(pa.array(["aa bb cc dd ee ff gg", "bb zz aa qq", "ee"]))
    p = toxicity._initial(rng.standard_normal(toxicity.WORD_ROWS).astype("f4"), rng.standard_normal(toxicity.CHAR_ROWS).astype("f4"), rng)
    for name in ("wx", "bx", "u"):
        setattr(p, name, [a.astype("f8") for a in getattr(p, name)])
    for name in ("word", "char", "att_w", "att_v", "out_w", "out_b"):
        setattr(p, name, getattr(p, name).astype("f8") * (50 if name in ("word", "char") else 1))
    _, start, size = toxicity.windows(w.first)
    y = np.array([1.0, 0, 1])

    def loss():
        x = toxicity.inputs(p, w).astype("f8")
        logit = toxicity._forward(p, *toxicity._lanes(w, start, size), [x @ p.wx[i] + p.bx[i] for i in (0, 1)], False)[0]
        return np.mean(np.log1p(np.exp(-np.where(y > 0, logit, -logit))))
    grads = {}
    toxicity._step(p, w, start, size, y, lambda key, value, g, rows=None, rate=0: grads.__setitem__(key, (g.copy(), rows)),
                   (p.word_odds, p.char_odds), 1.0)
    for key, a in ((("u", 0), p.u[0]), (("u", 1), p.u[1]), (("wx", 1), p.wx[1]), ("att_w", p.att_w), ("out_w", p.out_w), ("char", p.char)):
        g, rows = grads[key]
        at = tuple(rng.integers(0, n) for n in g.shape)
        real = at if rows is None else (rows[at[0]], at[1])
        old = a[real]
        a[real] = old + 1e-3
        high = loss()
        a[real] = old - 1e-3
        low = loss()
        a[real] = old
        assert np.isclose(g[at], (high - low) / 2e-3, rtol=2e-2, atol=2e-5)


def test_sets_of_more_than_four_languages():
    langs = [f"l{i}" for i in range(7)]
    rng = np.random.default_rng(4)

    def text(g, n):
        letters = [chr(97 + (3 * g + i) % 26) for i in range(3)]
        return " ".join("".join(rng.choice(letters, 5)) for _ in range(n))

    counts = np.ones((7, langid.BUCKETS))
    for g in range(7):
        data, off = langid.S.text_bytes(pa.array([text(g, 2000)]))
        counts[g] += np.bincount(langid.trigrams(data, off)[0], minlength=langid.BUCKETS)
    model = langid.Model(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
    mixed = [" ".join(text(g, 40 + 10 * (g == 2)) for g in range(n)) for n in (3, 5, 6, 7)]
    pred, _, size = langid.infer(*langid.S.text_bytes(pa.array([*mixed, text(1, 50)])), model)
    assert size.tolist() == [3, 5, 6, 7, 1] and pred.tolist() == [2, 2, 2, 2, 1]
