"""Byte-level suffix-array dedup by difference-cover blockwise construction.

A shard's suffixes are sorted one bucket at a time (buckets of similar size between sampled
first-eight-byte splitters), so memory holds one bucket's keys.  Suffixes are compared by their
first 32 bytes as big-endian words; longer ties are resolved by the precomputed ranks of a
difference-cover sample: for any two positions there is a shift of less than 31 bytes after which
both are sample positions, and the sample's ranks (of 62 bytes, built by sorting 32 and doubling)
decide.  Tied groups are split three ways around a pivot, all groups at once; equal suffixes
leave after one round.  Neighbours in the sorted order that share the window length form a class,
and a class knows its smallest document.

Cases: null texts are empty; texts shorter than a window stay whole; repeated rows (same id and
text) do not remove each other, as neither id is smaller; a row with a null doc_id takes no part and
stays whole; empty tables and extra columns are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsdesk.llm.common import sha256_hex
from opsdesk.llm.repeats import layout, repeated_ranges, with_ranges

WINDOW = 50                  # bytes
ANCHOR = 16                  # bytes of an anchor k-gram
# a perfect difference set: every difference modulo 31 occurs exactly once
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
PREFIX_WORDS = 4             # 8-byte words compared before ties go to the sample ranks
BUCKET = 500_000             # suffixes sorted at a time


def _shift_table() -> np.ndarray:
    """shift[a, b]: smallest d with a + d and b + d both in the cover (modulo the period)."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    a, b = np.meshgrid(np.arange(PERIOD), np.arange(PERIOD), indexing="ij")
    out = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        out[member[(a + d) % PERIOD] & member[(b + d) % PERIOD]] = d
    return out


SHIFT = _shift_table()


class SuffixBlocks:
    """Sorting of chosen suffixes of one text by bounded buckets and cover-sample ranks."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        wide = np.zeros(n + 160, np.uint64)
        wide[:n] = text
        self.key = np.zeros(n + 96, np.uint64)               # eight bytes from each position
        for i in range(8):
            self.key |= wide[i:i + n + 96] << np.uint64(56 - 8 * i)
        at = np.arange(n + PERIOD)
        sample = at[np.isin(at % PERIOD, COVER)]
        self.rank = np.zeros(n + 3 * PERIOD, np.int32)
        order, group = self._prefix_sorted(sample)
        self.rank[sample[order]] = group + 1
        second = self.rank[sample + PERIOD].astype(np.int64)
        pair = self.rank[sample].astype(np.int64) << 32 | second
        _, full = np.unique(pair, return_inverse=True)
        self.rank[sample] = full + 1

    def _prefix_sorted(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, group): pos[order] sorted by the first 32 bytes, groups of equal ones."""
        k = self.key[pos]
        order = np.argsort(k)
        k = k[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        for w in range(1, PREFIX_WORDS):
            tied = ~head
            tied[:-1] |= ~head[1:]
            act = np.flatnonzero(tied)
            if not len(act):
                break
            group = np.cumsum(head[act])
            k = self.key[pos[order[act]] + 8 * w]
            by = np.argsort(k)
            step = k[by]
            dense = np.empty(len(act), np.int64)
            dense[by] = np.cumsum(np.concatenate([[0], step[1:] != step[:-1]]))
            both = group << 32 | dense
            by = np.argsort(both)
            order[act] = order[act[by]]
            both = both[by]
            new = np.concatenate([[True], both[1:] != both[:-1]])
            head[act] |= new
        return order, np.cumsum(head) - 1

    def _split_ties(self, pos: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort within groups of equal prefix by the sample ranks: three-way partition around a
        pivot per group, all groups at once.  Returns (pos, head of equal suffixes)."""
        n = len(pos)
        head = np.concatenate([[True], group[1:] != group[:-1]])
        settled = np.zeros(n, bool)
        while True:
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, n))
            open_ = (size > 1) & ~settled[start]
            if not open_.any():
                return pos, head
            start, size = start[open_], size[open_]
            act = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            mine = pos[act]
            pivot = np.repeat(pos[start + size // 2], size)
            d = SHIFT[mine % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[mine + d].astype(np.int64) - self.rank[pivot + d]) + 1
            which = np.repeat(np.arange(len(start)), size) * 3 + side
            by = np.argsort(which, kind="stable")
            pos[act] = mine[by]
            which = which[by]
            new = np.concatenate([[True], which[1:] != which[:-1]])
            head[act] |= new
            settled[act] = which % 3 == 1

    def same_window(self, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
        """Do the windows at a and b agree (compared eight bytes at a time)."""
        same = np.ones(len(a), bool)
        steps = [8 * i for i in range(window // 8)] + ([window - 8] if window % 8 and window >= 8 else [])
        live = np.arange(len(a))
        for s in steps:
            live = live[self.key[a[live] + s] == self.key[b[live] + s]]
        same[:] = False
        same[live] = True
        return same

    def classes(self, pos: np.ndarray, window: int, value: np.ndarray) -> np.ndarray:
        """Smallest ``value`` among the suffixes that share their first ``window`` bytes."""
        out = np.empty(len(pos), value.dtype)
        first = self.key[pos]
        buckets = max(1, -(-len(pos) // BUCKET))
        probe = np.sort(first[::max(1, len(first) // (64 * buckets))])
        split = np.unique(probe[(np.arange(1, buckets) * len(probe)) // buckets]) if buckets > 1 else probe[:0]
        bucket = np.searchsorted(split, first, side="right")
        del first
        by_bucket = np.argsort(bucket.astype(np.uint16) if len(split) < 65535 else bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=len(split) + 1))
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            if a == b:
                continue
            mine = by_bucket[a:b]
            order, group = self._prefix_sorted(pos[mine])
            # carry the place of every suffix through the tie split by sorting positions (unique)
            sorted_pos, head = self._split_ties(pos[mine][order], group)
            edge = np.flatnonzero(head[1:]) + 1
            head[edge] = ~self.same_window(sorted_pos[edge - 1], sorted_pos[edge], window)
            place = mine[np.searchsorted(pos[mine], sorted_pos)]
            start = np.flatnonzero(head)
            low = np.minimum.reduceat(value[place], start)
            out[place] = np.repeat(low, np.diff(np.append(start, len(place))))
        return out


def smallest_docs(text: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, windows: np.ndarray,
                  doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Engine of a shard: the smallest document of each window, segment by segment."""
    index = SuffixBlocks(text)
    w_at = np.cumsum(windows) - windows
    pos = np.repeat(seg_start - w_at, windows) + np.arange(int(windows.sum()))
    return index.classes(pos, window, np.repeat(doc, windows))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, emit_spans: bool = False) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a document with a
    smaller doc_id.  Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``emit_spans``, the runs as array<struct<start,end>>."""
    if not 8 <= window <= 2 * PERIOD or k > window:
        raise ValueError(f"the window is from 8 to {2 * PERIOD} bytes, the anchor no longer than it")
    dealt, shards = layout(docs)
    ranges = repeated_ranges(dealt, shards, "byte", window, k,
                             lambda text, a, b, wins, doc: smallest_docs(text, a, b, wins, doc, window))

    def finish(u, gone: np.ndarray, piece: pa.RecordBatch) -> pa.RecordBatch:
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        cut = u.off[:-1][u.off[:-1] < len(gone)]
        head[cut] = gone[cut]
        removed = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(head)])
        kept = u.data[~gone]
        at = u.off - removed[u.off]
        cols = [piece.column("doc_id"), pa.array(u.off[1:] - u.off[:-1]),
                pa.array(removed[u.off[1:]] - removed[u.off[:-1]]), pa.array(spans[u.off[1:]] - spans[u.off[:-1]]),
                pa.array([sha256_hex(kept[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if emit_spans:
            tail = gone.copy()
            tail[:-1] &= ~gone[1:]
            end = u.off[1:][u.off[1:] > u.off[:-1]] - 1
            tail[end] = gone[end]
            s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
            d = np.searchsorted(u.off, s, side="right") - 1
            lists: list[list] = [[] for _ in range(piece.num_rows)]
            for i, x, y in zip(d.tolist(), (s - u.off[d]).tolist(), (e - u.off[d]).tolist()):
                lists[i].append({"start": x, "end": y})
            cols.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names.append("spans")
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_ranges(dealt, ranges, "byte", finish, schema + (", spans array<struct<start:long,end:long>>" if emit_spans else ""))
