"""Language identification by multilingual mixture inference.

Training counts byte trigrams of the lower-cased words (with their borders) per language over all
training rows; add-one smoothing gives trigram log-likelihoods, hashed to a fixed number of
buckets, so the model's size depends on the languages only.  A document is a mixture: every word
comes from one language.  Expectation-maximisation estimates the document's language proportions
from the words' likelihoods; the language set is the nested set (languages by falling proportion)
of greatest penalised likelihood (BIC).  The prediction is the largest language of that set.

All documents of a batch go through each EM step together as array operations.

Cases: null texts and texts without a letter (of any script) are ``und`` with score 0; rows with a
null language or null text teach nothing; without any training row everything is ``und``; repeated
rows are predicted for themselves; empty tables and extra columns are fine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import id_text, map_pieces, pieces, prepare, releasing

BUCKETS = 1 << 15
STEPS = 12                   # EM steps
PRIOR = 0.01                 # words of prior weight per language in each step
LETTER_BYTES = S.word_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTER = regex.compile(r"\p{L}")
UND = "und"


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray             # (languages, BUCKETS) float32


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 (C3 80 .. C3 9E) in lower case."""
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 0x20
    lead = np.flatnonzero(data[:-1] == 0xC3)
    nxt = data[lead + 1]
    low[lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1] += 0x20
    return low


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each word byte, start of each word in it, first word of each
    document); word borders count as blanks."""
    low = _lower(data)
    starts, ends, first = S.words(low, off, LETTER_BYTES)
    inside = LETTER_BYTES[low]
    at = np.flatnonzero(inside)
    code = np.where(inside, low, np.uint8(0x20)).astype(np.uint32)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[:1] = 0x20
    before[starts] = 0x20
    after = np.empty_like(code)
    after[:-1] = code[1:]
    after[-1:] = 0x20
    after[ends - 1] = 0x20
    gram = (before << 16 | code << 8 | after)[at]
    with np.errstate(over="ignore"):
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - 15)
    length = ends - starts
    return bucket.astype(np.int32), np.cumsum(length) - length, first


def train(rows: DataFrame) -> Model:
    """Fit on all rows of (text, lang) with a non-null language.  Counts are summed by Spark; the
    driver receives languages x BUCKETS sums."""
    prepare(rows.sparkSession)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                data, off = S.text_bytes(piece.column("text"))
                bucket, w_at, first = trigrams(data, off)
                lang = piece.column("lang").dictionary_encode()
                names = lang.dictionary.to_pylist()
                code = lang.indices.to_numpy(zero_copy_only=False)
                length = np.diff(np.append(w_at, len(bucket)))
                words = np.repeat(code, first[1:] - first[:-1]).astype(np.int64)
                both = np.bincount(np.repeat(words, length) * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for i, name in enumerate(names):
                    part = both[i * BUCKETS:(i + 1) * BUCKETS]
                    total[name] = total[name] + part if name in total else part
        for name, part in total.items():
            some = np.flatnonzero(part)
            if not len(some):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(part[some].astype(np.int64))],
                names=["lang", "bucket", "n"])

    counts = rows.where("lang is not null and text is not null").select("text", "lang") \
        .mapInArrow(releasing(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()                           # bounded by languages x BUCKETS
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.ones((len(langs), BUCKETS))
    row = np.searchsorted(np.array(langs, object), got.column("lang").to_numpy(zero_copy_only=False)) if langs else []
    table[row, np.asarray(got.column("bucket"))] += np.asarray(got.column("n"))
    return Model(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if langs else table)


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]] for documents that all have words."""
    return np.add.reduceat(values, first[:-1])


def _em(like: list[np.ndarray], first: np.ndarray, doc: np.ndarray, share: list[np.ndarray], steps: int
        ) -> tuple[list[np.ndarray], np.ndarray]:
    """EM of the proportions; (shares, log-likelihood sums per document) after ``steps``."""
    words = (first[1:] - first[:-1]).astype(np.float32)
    n = len(like)
    for _ in range(steps):
        mixed = [s[doc] * l for s, l in zip(share, like)]
        total = sum(mixed[1:], mixed[0].copy())
        share = [(_sum_by(m / total, first) + PRIOR) / (words + PRIOR * n) for m in mixed]
    total = sum(s[doc] * l for s, l in zip(share, like))
    return share, _sum_by(np.log(total), first)


def infer(data: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index or -1, score, number of languages in the chosen set) per document."""
    docs, k = len(off) - 1, len(model.langs)
    pred, score, chosen = np.full(docs, -1), np.zeros(docs), np.zeros(docs, np.int64)
    bucket, w_at, first = trigrams(data, off)
    some = np.flatnonzero(first[1:] > first[:-1])
    if not k or not len(some):
        return pred, score, chosen
    first = np.append(first[some], first[-1])
    doc = np.repeat(np.arange(len(some)), first[1:] - first[:-1])
    ll = [np.add.reduceat(model.logp[i][bucket], w_at) for i in range(k)]
    top = ll[0].copy()
    for x in ll[1:]:
        np.maximum(top, x, out=top)
    like = [np.exp(np.maximum(x - top, np.float32(-40))) for x in ll]
    even = [np.full(len(some), 1 / k, np.float32) for _ in range(k)]
    share, _ = _em(like, first, doc, even, STEPS)
    shares = np.stack(share, 1)
    rank = np.argsort(-shares, 1, kind="stable")
    words = first[1:] - first[:-1]
    # one language: the sum of its log-likelihoods; more: the fitted mixture of the largest ones
    single = np.stack([_sum_by(x - top, first) for x in ll], 1)
    best_one = single.argmax(1)
    best = single.max(1).astype(np.float64)
    size = np.ones(len(some), np.int64)
    answer = best_one.copy()
    for s in range(2, k + 1):
        member = np.zeros((len(some), k), np.float32)
        np.put_along_axis(member, rank[:, :s], 1, 1)
        part = shares * member
        part /= part.sum(1, keepdims=True)
        total = sum(np.ascontiguousarray(part[:, i])[doc] * like[i] for i in range(k))
        value = _sum_by(np.log(np.maximum(total, np.float32(1e-30))), first) - 0.5 * (s - 1) * np.log(words + 1.0)
        better = value > best
        best[better], size[better] = value[better], s
        answer[better] = rank[better, 0]
    pred[some] = answer
    score[some] = np.clip(shares[np.arange(len(some)), answer], 0, 1)
    chosen[some] = size
    return pred, score, chosen


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` (they include text) with lang_pred, score and n_langs."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # languages x BUCKETS floats
    frame = docs.select(*keep)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        data, off = S.text_bytes(piece.column("text"))
        pred, score, size = infer(data, off, m)
        # ASCII letters decide at once; other texts are asked for a letter of any script
        plain = np.concatenate([[0], np.cumsum(LETTER_BYTES[data] & (data < 0x80))])
        for d in np.flatnonzero((plain[off[1:]] == plain[off[:-1]]) & (pred >= 0)):
            if not LETTER.search(piece.column("text")[int(d)].as_py()):
                pred[d], score[d], size[d] = -1, 0.0, 0
        names = np.array([*m.langs, UND], object)
        return pa.RecordBatch.from_arrays(
            [*piece.columns, pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.array(size)],
            names=[*keep, "lang_pred", "score", "n_langs"])

    from pyspark.sql import types as T
    schema = T.StructType([*frame.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("n_langs", T.LongType())])
    return map_pieces(frame, run, schema)


def remainder(column: str, by: int):
    """crc32(column as text) mod by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def identify(docs: DataFrame) -> DataFrame:
    """The registered query: learn where crc32(doc_id) mod 5 is not 0, predict every row."""
    model = train(docs.where(remainder("doc_id", 5) != 0))
    rows = id_text(docs).withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return predict(rows, model, ["doc_id", "text", "held_out"]).drop("text")
