"""TX5: pluggable batch embedder (Arrow pandas UDF).

The default embedder is the signed feature hash with blake2b token digests (bit-parity with
the behaviour being reproduced: bucket = first 4 digest bytes little-endian mod dims, sign +
when byte 5 is odd), normalised to unit length.  Any other model can be plugged in with
``make_embedder(fn)`` where ``fn(list[str]) -> list[list[float]]`` runs once per Arrow batch
(models are loaded once per Python worker and cached at module level).
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from opsdesk.functions.lexicon import HASH_DIMS, TOKEN_PATTERN

_TOKEN = regex.compile(r"[\w₹]+")
_SQL_TOKEN = regex.compile(TOKEN_PATTERN)


def blake2b_bucket_sign(token: str, dims: int = HASH_DIMS) -> tuple[int, int]:
    raw = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(raw[:4], "little") % dims, (1 if raw[4] & 1 else -1)


def hashed_vectors(texts: list[str], dims: int = HASH_DIMS) -> list[list[float]]:
    """Unit vectors of a batch of texts: every different token is hashed once, the counts are one
    scatter-add, the vectors are normalised together."""
    tokens = [_TOKEN.findall((text or "").lower()) for text in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(t, len(number)) for row in tokens for t in row), np.int64, int(sizes.sum()))
    if not len(at):
        return np.zeros((len(texts), dims), np.float32).tolist()
    place = np.array([blake2b_bucket_sign(t, dims) for t in number], np.int64)
    cell = np.repeat(np.arange(len(texts)), sizes) * dims + place[at, 0]
    v = np.bincount(cell, place[at, 1].astype(np.float64), len(texts) * dims).reshape(-1, dims)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1.0)).astype(np.float32).tolist()


def make_embedder(fn: Callable[[list[str]], list[list[float]]]):
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(fn(s.fillna("").tolist()))
    return embed


hashed_embedder = make_embedder(hashed_vectors)


def counted_vectors(texts: list[str]) -> list[list[float]]:
    """Unscaled md5 feature hashes, equal to ``hash_embed``."""
    import pyarrow as pa

    from opsdesk.operators.vectors import hashed_rows
    tokens = pa.array([_SQL_TOKEN.findall((t or "").lower()) for t in texts], pa.list_(pa.string()))
    return hashed_rows(tokens).astype(np.float32).tolist()


counted_embedder = make_embedder(counted_vectors)


def embed_column(text: Column, embedder=None) -> Column:
    return (embedder or hashed_embedder)(text)


@F.pandas_udf(StructType([StructField(name, LongType()) for name in ("dims", "nnz", "norm2", "moment")]))
def vector_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Size, non-zero entries, squared norm and first moment (sum of place x value) of integral vectors.
    Around an embedder it runs in the same Python pass, so the vectors never leave it."""
    for vectors in batches:
        v = np.array([np.asarray(x) for x in vectors], np.float64).reshape(len(vectors), -1)
        yield pd.DataFrame({"dims": np.full(len(v), v.shape[1], np.int64), "nnz": (v != 0).sum(1), "norm2": (v * v).sum(1).astype(np.int64),
                            "moment": (v @ np.arange(v.shape[1], dtype=np.float64)).astype(np.int64)})
