"""Vectorised scanning of Arrow text batches (numpy only; runs inside Spark tasks).

A batch of texts is handled as one byte array plus document offsets.  Words, rolling hashes and
window minimisers are computed for the whole batch at once, so cost per byte is a handful of
array passes and nothing is executed per word in Python.  All hashes depend on content alone:
equal words, n-grams and windows get equal values in every batch, task and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1          # odd, so invertible modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            m = min(done, n - done)
            out[done:done + m] = out[:m] * U64(pow(base, done, 1 << 64))
            done += m
    return out


class _Powers:
    """Powers of the hash base and its inverse, grown on demand and kept until the task ends."""
    fwd = _powers(_R, 1)
    inv = _powers(_RINV, 1)

    @classmethod
    def forget(cls) -> None:
        cls.fwd, cls.inv = _powers(_R, 1), _powers(_RINV, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.fwd) < n:
            size = max(n, 2 * len(cls.fwd), 1 << 16)
            cls.fwd, cls.inv = _powers(_R, size), _powers(_RINV, size)
        return cls.fwd, cls.inv


def forget() -> None:
    """Drop what is kept between calls (at the end of a task: Python workers live on)."""
    _Powers.forget()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift / multiply), so that every bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x *= U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(33)
        x *= U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(33)
    return x


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string / binary column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    else:
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j] = sum of codes[i] * R**i for i < j (modulo 2**64)."""
    fwd, _ = _Powers.upto(len(codes) + 1)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(codes * fwd[:len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed content hash of codes[start:end] for arrays of ranges."""
    _, inv = _Powers.upto(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inv[start]
                   + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed content hash of every run of k codes (starts 0 .. n-k)."""
    n = len(prefix) - 1 - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    _, inv = _Powers.upto(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[k:k + n] - prefix[:n]) * inv[:n])


def word_table(*delimiters: tuple[int, int]) -> np.ndarray:
    """256 flags, True for word bytes; delimiters are inclusive byte ranges."""
    out = np.ones(256, bool)
    for lo, hi in delimiters:
        out[lo:hi + 1] = False
    return out


SPACE_WORDS = word_table((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORDS = word_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE_WORDS
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words and, per document, the index of its first
    word (length documents + 1).  Words never cross a document boundary."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    begin = inside[:n].copy()
    begin[1:] &= ~inside[:n - 1]
    cut = offsets[:-1]
    cut = cut[cut < n]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    # a word ends where the next byte is a delimiter, another document begins, or the data ends
    stop = inside[:n] & ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner <= n)]
    stop[inner - 1] = inside[inner - 1]
    ends = np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets, side="left")
    return starts, ends, first


def window_anchors(order: np.ndarray, first: np.ndarray, k: int, window: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group windows of ``window`` consecutive items by their minimiser.

    ``order`` holds the mixed hash of the k-gram starting at every item; documents are
    [first[d], first[d+1]).  The anchor of a window is its leftmost k-gram of smallest hash, a
    function of the window's content alone.  Returns (anchor, lo, hi): item position of the
    anchor's k-gram and the range of window starts (inclusive) that share it, document by
    document in order.  Every window of every document is in exactly one range.
    """
    span = window - k + 1
    n = len(order) - span + 1
    if n <= 0 or len(first) < 2:
        z = np.empty(0, np.int64)
        return z, z, z
    key = (order >> U64(32) << U64(32)) | np.arange(len(order), dtype=np.uint64)
    low = key
    have = 1
    while have < span:                       # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    pos = (low[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    # window starts must keep the window inside its document
    last = np.minimum(first[1:] - window, n - 1)
    ok = np.zeros(n + 1, np.int32)
    good = last >= first[:-1]
    np.add.at(ok, first[:-1][good], 1)
    np.add.at(ok, last[good] + 1, -1)
    ok = np.cumsum(ok[:n]) > 0
    head = ok.copy()
    head[1:] &= (pos[1:] != pos[:-1]) | ~ok[:-1]
    doc_head = first[:-1][good]
    head[doc_head] = True
    tail = ok.copy()
    tail[:-1] &= (pos[1:] != pos[:-1]) | ~ok[1:]
    tail[last[good]] = True
    lo = np.flatnonzero(head)
    hi = np.flatnonzero(tail)
    return pos[lo], lo, hi


def covered(first: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask over n items covered by the union of [lo, hi)."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, lo, 1)
    np.add.at(diff, hi, -1)
    return np.cumsum(diff[:n]) > 0
