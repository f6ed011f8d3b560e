"""Substring dedup with a compressed FM-index per shard.

The shard's text (distinct word segments, one separator symbol after each) is indexed by its
Burrows-Wheeler transform held in a wavelet matrix of packed bits with sampled popcounts.
Streamed segments are matched right to left by backward search, many at once: each step is two
rank queries per level for all lanes.  When a step fails, the match is shortened to its parent
interval (by the longest common prefixes) until the symbol fits, so the search computes true
matching statistics for any streamed text.  Where a match reaches the window length, the rows of
the window's own interval are found through a bit vector of interval starts, and each interval
knows its smallest document.

Cases: null and short texts have no window and stay whole; repeated rows (same id and text) do not
remove each other, as neither id is smaller; a row with a null doc_id takes no part and stays
whole; empty tables and extra columns are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsdesk.llm import textscan as S
from opsdesk.llm.common import sha256_hex
from opsdesk.llm.repeats import layout, repeated_ranges, with_ranges

WINDOW = 50                 # words
ANCHOR = 8                  # words of an anchor k-gram


class PackedBits:
    """Bits in 64-bit words with a running count per word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[:len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank over an integer sequence, one packed bit vector per bit of the symbols."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.shifts = list(range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bit = ((seq >> shift) & 1).astype(bool)
            level = PackedBits(bit)
            self.levels.append(level)
            self.zeros.append(len(seq) - level.ones)
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.origin = self.map(np.arange(symbols), np.zeros(symbols, np.int64))

    def map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            one = level.rank(i)
            i = np.where((c >> shift) & 1, zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols."""
        return self.map(c, i) - self.origin[c]


def prefix_ranks(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """ranks[k][i]: rank of text[i : i + 2**k] among all of that length (equal if equal); up to
    the first power of two that is at least ``depth``.  The end sorts before everything."""
    n = len(text)
    ranks = [text.astype(np.int64)]
    h = 1
    while h < depth:
        r = ranks[-1]
        second = np.zeros(n, np.int64)
        second[:n - h] = r[h:] + 1
        key = r * (n + 2) + second
        order = np.argsort(key)
        sorted_key = key[order]
        dense = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        out = np.empty(n, np.int64)
        out[order] = dense
        ranks.append(out)
        h *= 2
    return ranks


class FmIndex:
    """FM-index of integer segments (symbols from 1; 0 separates segments)."""

    def __init__(self, segments: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, symbols: int, depth: int):
        """Segments are segments[seg_start:seg_end]; ``symbols`` counts the separator;
        ``depth`` is the longest match that is ever asked for."""
        size = seg_end - seg_start
        n = int(size.sum()) + len(size)
        text = np.zeros(n, np.int64)
        place = np.arange(len(segments)) + np.repeat(np.arange(len(size)), size)
        text[place] = segments
        self.n, self.symbols = n, symbols
        ranks = prefix_ranks(text, depth + 1)
        sa = np.argsort(ranks[-1], kind="stable")
        self.lcp = self._lcp(ranks, sa)
        self.sa = sa
        bwt = text[sa - 1]
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        self.tree = WaveletMatrix(bwt, symbols)
        self._minima = None

    def _lcp(self, ranks: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
        """lcp[r]: common prefix of rows r-1 and r (capped by the depth); lcp[0] = lcp[n] = -1."""
        out = np.full(self.n + 1, -1, np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        at = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            fits = (a + at < self.n) & (b + at < self.n)
            same = np.zeros(len(a), bool)
            same[fits] = ranks[k][(a + at)[fits]] == ranks[k][(b + at)[fits]]
            at += same.astype(np.int64) << k
        out[1:self.n] = at
        return out.astype(np.int16)

    def windows(self, length: int, doc: np.ndarray, seg_of: np.ndarray) -> None:
        """Prepare intervals of rows that share ``length`` symbols and their smallest document."""
        start = self.lcp[:self.n] < length
        self.interval = PackedBits(start)
        lines = np.concatenate([doc, [np.iinfo(np.int64).max]])[seg_of][self.sa]
        self.smallest = np.minimum.reduceat(lines, np.flatnonzero(start)) if self.n else lines

    def interval_doc(self, row: np.ndarray) -> np.ndarray:
        return self.smallest[self.interval.rank(row + 1) - 1]

    def _shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent intervals: (lo, hi, length of the match)."""
        if self._minima is None:                             # sparse table of lcp minima
            levels = [self.lcp]
            step = 1
            while 2 * step <= len(self.lcp):
                levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
                step *= 2
            self._minima = levels
        length = np.maximum(self.lcp[lo], self.lcp[hi]).astype(np.int64)
        for k in range(len(self._minima) - 1, -1, -1):
            table, step = self._minima[k], 1 << k
            at = lo - step + 1
            ok = at >= 0
            ok[ok] = table[at[ok]] >= length[ok]
            lo = np.where(ok, lo - step, lo)
            ok = hi < len(table)
            ok[ok] = table[hi[ok]] >= length[ok]
            hi = np.where(ok, hi + step, hi)
        return lo, hi, length

    def matching(self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray, visit) -> None:
        """Stream the ranges of ``queries`` right to left, all at once.  After every step
        ``visit(lanes, position, lo, match)`` gets the lanes still running (indices into starts),
        their positions in ``queries``, the first row of their interval and the length of the
        longest match that begins at the position.  Symbols unknown to the index are negative."""
        order = np.argsort(starts - ends, kind="stable")
        size = (ends - starts)[order]
        lo = np.zeros(len(order), np.int64)
        hi = np.full(len(order), self.n, np.int64)
        match = np.zeros(len(order), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = ends[order[:live]] - 1 - t
            todo = np.arange(live)
            c = queries[at]
            dead = c < 0
            lo[:live][dead], hi[:live][dead], match[:live][dead] = 0, self.n, 0
            todo = todo[~dead]
            while len(todo):
                sym = c[todo]
                both = self.tree.rank(np.concatenate([sym, sym]), np.concatenate([lo[todo], hi[todo]]))
                new_lo = self.count[sym] + both[:len(todo)]
                new_hi = self.count[sym] + both[len(todo):]
                ok = new_hi > new_lo
                go = todo[ok]
                lo[go], hi[go] = new_lo[ok], new_hi[ok]
                match[go] += 1
                todo = todo[~ok]
                stuck = match[todo] == 0                     # not even the symbol itself occurs
                todo = todo[~stuck]
                if len(todo):
                    lo[todo], hi[todo], match[todo] = self._shorten(lo[todo], hi[todo])
            visit(order[:live], at, lo[:live], match[:live])


def smallest_docs(text: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, windows: np.ndarray,
                  doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Engine of a shard: index the distinct segments, stream them, and give the smallest
    document of each window, segment by segment."""
    # words of the segments as dense symbols from 1
    starts, ends, first = S.words(text, np.concatenate([seg_start, seg_end[-1:]]))
    hashes = S.range_hash(S.prefix_hash(S.BYTE_CODE[text]), starts, ends)
    vocab, symbol = np.unique(hashes, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    size = first[1:] - first[:-1]
    index = FmIndex(symbol, first[:-1], first[1:], len(vocab) + 1, int(size.max()))
    seg_of = np.repeat(np.arange(len(size)), size + 1)
    index.windows(window, doc, seg_of)
    w_at = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), np.iinfo(np.int64).max)

    def visit(lanes, at, lo, match):
        step = at - first[lanes]
        ok = (match >= window) & (step < windows[lanes])
        out[w_at[lanes[ok]] + step[ok]] = index.interval_doc(lo[ok])

    index.matching(symbol, first[:-1], first[1:], visit)
    return out


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, emit_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` consecutive words that also starts in
    a document with a smaller doc_id.  Per document: doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space) and, with ``emit_text``, that text."""
    dealt, shards = layout(docs)
    ranges = repeated_ranges(dealt, shards, "word", window, k,
                             lambda text, a, b, wins, doc: smallest_docs(text, a, b, wins, doc, window))

    def finish(u, gone: np.ndarray, piece: pa.RecordBatch) -> pa.RecordBatch:
        n = len(u.starts)
        keep = ~gone
        total = np.concatenate([[0], np.cumsum(gone)])
        # kept words joined by one space: the byte before a kept word that has one before it
        seen = np.concatenate([[0], np.cumsum(keep)])
        later = keep & (seen[:-1] > np.repeat(seen[u.first[:-1]], u.first[1:] - u.first[:-1]))
        data = u.data.copy()
        mask = np.zeros(len(data) + 1, np.int8)
        np.add.at(mask, u.starts[keep], 1)
        np.add.at(mask, u.ends[keep], -1)
        mask = np.cumsum(mask[:-1], dtype=np.int8) > 0
        gap = u.starts[later] - 1
        mask[gap] = True
        data[gap] = 0x20
        kept = data[mask]
        at = np.concatenate([[0], np.cumsum(mask)])[u.off]
        texts = [kept[at[d]:at[d + 1]].tobytes() for d in range(len(at) - 1)]
        cols = [piece.column("doc_id"), pa.array(u.first[1:] - u.first[:-1]),
                pa.array(total[u.first[1:]] - total[u.first[:-1]]), pa.array([sha256_hex(t) for t in texts])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if emit_text:
            cols.append(pa.array([t.decode("utf-8") for t in texts], pa.string()))
            names.append("text")
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if emit_text else "")
    return with_ranges(dealt, ranges, "word", finish, schema)
