"""Finding windows that also start in a document with a smaller id, shard by shard.

Shared by the substring operators, which differ in the index they build per shard.  Work is
arranged so that nothing is ever compared all against all and no window list is shuffled:

1. Documents are dealt into blocks by a hash of their id (one shuffle of the text, reused).
2. Every window of ``window`` units (words or bytes) has one anchor: its k-gram of smallest
   hash.  Windows are grouped by anchor, about one per ``window / 2`` units.  Blocks send their
   distinct anchor hashes to shards (by hash); a shard answers with one bit per anchor: does
   another block hold it too.
3. Blocks cut the segments (anchor's windows plus their tails) of shared anchors only, each
   distinct text once per block, and send them to the anchor's shard.  Equal windows have equal
   anchors, so all copies of a window meet in one shard.
4. A shard collapses equal segments, keeping the smallest doc_id, builds its index over the
   distinct ones and finds the smallest doc_id of every window.  It answers the blocks with the
   unit ranges of windows that start in a smaller document.
5. Blocks unite the ranges per document.

Copies of a hot passage add one anchor and one distinct segment per block.  Windows over its edges
share the anchor but hold each document's own words, so an anchor's distinct segments can be as many
as the documents.  Blocks send their number with the anchors, and the windows of an anchor with more
than ``hot`` of them are keyed one by one by their content hash: they go to shards of their own by
that hash, without text, where equal hashes are equal windows.  Equal windows still meet, as being
hot is the shard's answer to all blocks.  A use of a window (12 bytes) is sent for every occurrence,
so those of one window or segment that stands in very many documents still meet in one task.
Shards and blocks grow in number, not in size,
with the input; all of it is lineage over two reused exchanges, so lost executors only repeat
their part.  Hashes are 64-bit content hashes; equal windows are decided by the index itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import id_text, partitions, pieces, prepare

BLOCK_BYTES = 6 << 20        # text of one block
SHARD_BYTES = 8 << 20        # input text per shard
HOT_BYTES = 2 << 20          # about the text of one anchor's distinct segments before its windows are dealt out
_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed bytes of some arrays (their dtypes are known to the reader)."""
    raw = [np.ascontiguousarray(a).view(np.uint8).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    body = head + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec=_CODEC, asbytes=True)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(body, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out


class Units:
    """The units (words or bytes) of a piece of texts, their hashes and window anchors."""

    def __init__(self, piece: pa.RecordBatch, unit: str, k: int, window: int, anchors: bool = True):
        self.data, self.off = S.text_bytes(piece.column("text"))
        self.byte_prefix = S.prefix_hash(S.BYTE_CODE[self.data])
        if unit == "byte":
            self.first = self.off
            prefix = self.byte_prefix
        else:
            self.starts, self.ends, self.first = S.words(self.data, self.off)
            prefix = S.prefix_hash(S.range_hash(self.byte_prefix, self.starts, self.ends)) if anchors else None
        self.doc_id = np.array(piece.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
        valid = piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        # rows are told apart by id and content; equal rows share their result
        self.key = S.mix(S.range_hash(self.byte_prefix, self.off[:-1], self.off[1:])
                         ^ S.mix(self.doc_id.view(np.uint64) + S.U64(1)))
        if not anchors:
            del self.byte_prefix
            return
        order = S.gram_hash(prefix, k)
        at, self.lo, self.hi = S.window_anchors(order, self.first, k, window)
        self.anchor = order[at]
        self.doc = np.searchsorted(self.first, self.lo, side="right") - 1
        ok = valid[self.doc]                   # a null doc_id takes no part
        self.lo, self.hi, self.anchor, self.doc = self.lo[ok], self.hi[ok], self.anchor[ok], self.doc[ok]
        self.content = S.range_hash(prefix, self.lo, self.hi + window)
        del self.byte_prefix                   # eight times the text

    def window_hash(self, unit: str, window: int, start: np.ndarray) -> np.ndarray:
        """Content hashes of the windows at ``start`` (the prefixes are not kept, so made anew)."""
        prefix = S.prefix_hash(S.BYTE_CODE[self.data])
        if unit != "byte":
            prefix = S.prefix_hash(S.range_hash(prefix, self.starts, self.ends))
        return S.range_hash(prefix, start, start + window)

    def span(self, unit: str, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the segments."""
        if unit == "byte":
            return self.lo, self.hi + window
        return self.starts[self.lo], self.ends[self.hi + window - 1]


def _take(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """data[a0:b0], data[a1:b1], ... one after another."""
    size = b - a
    total = int(size.sum())
    if not total:
        return np.empty(0, data.dtype)
    at = np.cumsum(size) - size
    return data[np.repeat(a - at, size) + np.arange(total)]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of a grouping by key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def _mask48(x: np.ndarray) -> np.ndarray:
    return x >> S.U64(16)


def _to48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def _from48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def block_pieces(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from pieces(batch)


def layout(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt into blocks (blk, doc_id, text) and the number of shards."""
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(spark)
    blocks = max(parts, -(-size // BLOCK_BYTES))
    shards = max(parts, -(-size // SHARD_BYTES))
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    return dealt.repartition(parts, "blk"), int(shards)


def hot_segments(unit: str, window: int) -> int:
    """Distinct segments up to which an anchor stays in one shard."""
    return max(1, HOT_BYTES // (window * 3 // 2 * (1 if unit == "byte" else 6)))


def repeated_ranges(dealt: DataFrame, shards: int, unit: str, window: int, k: int, engine) -> DataFrame:
    """(blk, ranges): per block the unit ranges covered by windows that start in a smaller
    document.  ``engine(text, seg_start, seg_end, windows, doc)`` gives the smallest doc of every
    window of every segment, one after another."""
    hot = hot_segments(unit, window)

    def anchors(table: pa.Table) -> pa.Table:
        blk = table.column("blk")[0].as_py()
        seen = []
        for p in block_pieces(table):
            u = Units(p, unit, k, window)
            content, first = np.unique(u.content, return_index=True)
            seen.append((content, _mask48(u.anchor)[first]))
            del u
        _, first = np.unique(np.concatenate([c for c, _ in seen]), return_index=True)
        h, held = np.unique(np.concatenate([a for _, a in seen])[first], return_counts=True)
        order, starts = _groups((h % S.U64(shards)).astype(np.int64))
        bucket = (h % S.U64(shards)).astype(np.int64)[order[starts]] if len(h) else np.empty(0, np.int64)
        parts = np.split(order, starts[1:]) if len(h) else []
        blobs = [_to48(h[part]).tobytes() for part in parts]
        # anchors of more than one distinct segment here: place and number
        more = [(np.flatnonzero(held[part] > 1), held[part][held[part] > 1]) for part in parts]
        more = [np.concatenate(x).astype(np.uint32).tobytes() or None for x in more]
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blk": pa.array([blk] * len(blobs), pa.int64()),
                         "anchors": pa.array(blobs, pa.binary()), "more": pa.array(more, pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        parts = [_from48(np.frombuffer(x, np.uint8)) for x in table.column("anchors").to_pylist()]
        _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        base = np.cumsum([0] + [len(p) for p in parts])
        twice = np.split(count[inverse] > 1, base[1:-1])
        total = count.astype(np.int64)
        for at, blob in zip(base, table.column("more").to_pylist()):
            if blob:
                place, held = np.frombuffer(blob, np.uint32).reshape(2, -1).astype(np.int64)
                total[inverse[at + place]] += held - 1     # distinct within a block
        over = np.split((total > hot)[inverse], base[1:-1])
        return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"),
                         "bits": pa.array([np.packbits(t).tobytes() for t in twice], pa.binary()),
                         "hot": pa.array([np.packbits(t).tobytes() if t.any() else None for t in over], pa.binary())})

    def segments(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        blk = key[0].as_py()
        units = [Units(p, unit, k, window) for p in block_pieces(table)] if table.num_rows else []
        names = ["bucket", "blk", "docs", "uses", "texts"]
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())],
                         names=names)
        if not units:
            return empty
        a48 = [_mask48(u.anchor) for u in units]
        h = np.unique(np.concatenate(a48))
        if not len(h):
            return empty
        # anchors held by another block (the shards' bits), or by two documents of this one
        bucket = (h % S.U64(shards)).astype(np.int64)
        order, starts = _groups(bucket)
        answer = dict(zip(replies.column("bucket").to_pylist(), zip(replies.column("bits").to_pylist(),
                                                                    replies.column("hot").to_pylist())))
        ok, over = np.zeros(len(h), bool), np.zeros(len(h), bool)
        for part in np.split(order, starts[1:]):
            for flags, blob in zip((ok, over), answer[int(bucket[part[0]])]):
                if blob:
                    flags[part] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(part)) > 0
        ids = np.concatenate([u.doc_id[u.doc] for u in units])
        at = np.searchsorted(h, np.concatenate(a48))
        low = np.full(len(h), np.iinfo(np.int64).max)
        high = np.full(len(h), np.iinfo(np.int64).min)
        np.minimum.at(low, at, ids)
        np.maximum.at(high, at, ids)
        ok |= low < high
        out: list[list] = [[], [], [], [], []]

        def send(shard, content, doc, lo, wins, s0, s1, data, key64, doc_id):
            order, starts = _groups(shard)
            for part in np.split(order, starts[1:]) if len(order) else []:
                _, first, seg = np.unique(content[part], return_index=True, return_inverse=True)
                mine, d = np.unique(doc[part], return_inverse=True)
                rep = part[first]
                text = _take(data, s0[rep], s1[rep])
                out[0].append(int(shard[part[0]]))
                out[1].append(blk)
                out[2].append(pack(key64[mine], doc_id[mine]))
                out[3].append(pack(d.astype(np.int32), lo[part].astype(np.int32), seg.astype(np.int32)))
                out[4].append(pack((s1[rep] - s0[rep]).astype(np.int32), wins[rep].astype(np.int32),
                                   content[rep], text))

        rows = []
        for u, a in zip(units, a48):
            at = np.searchsorted(h, a)
            pick = np.flatnonzero(ok[at] & over[at])
            if len(pick):                          # windows of hot anchors, by their content hash
                n = u.hi[pick] - u.lo[pick] + 1
                w = _take(np.arange(int(u.first[-1])), u.lo[pick], u.hi[pick] + 1)
                doc, content, none = np.repeat(u.doc[pick], n), u.window_hash(unit, window, w), np.zeros(len(w), np.int64)
                send((content % S.U64(shards)).astype(np.int64) + shards, content, doc, w - u.first[doc], none + 1,
                     none, none, u.data[:0], u.key, u.doc_id)
            pick = np.flatnonzero(ok[at] & ~over[at])
            s0, s1 = u.span(unit, window)
            rows.append((a[pick], u.content[pick], u.doc[pick], u.lo[pick] - u.first[u.doc[pick]],
                         u.hi[pick] - u.lo[pick] + 1, s0[pick], s1[pick]))
        base = np.cumsum([0] + [len(u.doc_id) for u in units])
        size = np.cumsum([0] + [len(u.data) for u in units])
        anchor, content, doc, lo, wins, s0, s1 = (np.concatenate(x) for x in zip(*[
            (a, c, d + base[i], lo, w, x + size[i], y + size[i]) for i, (a, c, d, lo, w, x, y) in enumerate(rows)]))
        data = np.concatenate([u.data for u in units])
        key64 = np.concatenate([u.key for u in units])
        doc_id = np.concatenate([u.doc_id for u in units])
        del units, rows
        send((anchor % S.U64(shards)).astype(np.int64), content, doc, lo, wins, s0, s1, data, key64, doc_id)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         *[pa.array(c, pa.binary()) for c in out[2:]]], names=names)

    def index(table: pa.Table) -> pa.Table:
        single = table.column("bucket")[0].as_py() >= shards          # windows of hot anchors
        doc_tabs = [unpack(x, np.uint64, np.int64) for x in table.column("docs").to_pylist()]
        uses = [unpack(x, np.int32, np.int32, np.int32) for x in table.column("uses").to_pylist()]
        texts = [unpack(x, np.int32, np.int32, np.uint64, np.uint8) for x in table.column("texts").to_pylist()]
        n_seg = np.cumsum([0] + [len(t[0]) for t in texts])
        content = np.concatenate([t[2] for t in texts])
        _, first, seg_of = np.unique(content, return_index=True, return_inverse=True)
        # smallest document of every distinct segment
        low = np.full(len(first), np.iinfo(np.int64).max)
        for i, (d, _, seg) in enumerate(uses):
            np.minimum.at(low, seg_of[seg + n_seg[i]], doc_tabs[i][1][d])
        size = np.concatenate([t[0] for t in texts]).astype(np.int64)
        wins = np.concatenate([t[1] for t in texts]).astype(np.int64)[first]
        end = np.cumsum(size)
        text = _take(np.concatenate([t[3] for t in texts]), (end - size)[first], end[first])
        del texts
        seg_end = np.cumsum(size[first])
        mind = low if single else engine(text, seg_end - size[first], seg_end, wins, low)
        w_at = np.cumsum(wins) - wins
        seg_min = np.minimum.reduceat(mind, w_at)
        seg_max = np.maximum.reduceat(mind, w_at)
        blobs = []
        for i, (d, lo, seg) in enumerate(uses):
            keys, ids = doc_tabs[i]
            own, s, lo = ids[d], seg_of[seg + n_seg[i]], lo.astype(np.int64)
            all_of = np.flatnonzero(seg_max[s] < own)
            some = np.flatnonzero((seg_max[s] >= own) & (seg_min[s] < own))
            r_doc, r_lo, r_hi = [d[all_of]], [lo[all_of]], [lo[all_of] + wins[s[all_of]] - 1 + window]
            if len(some):
                each = wins[s[some]]
                row = np.repeat(np.arange(len(some)), each)
                step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                gone = mind[w_at[s[some]][row] + step] < own[some][row]
                edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gone[1:] != gone[:-1])]))
                stop = np.concatenate([edge[1:], [len(row)]]) - 1
                edge, stop = edge[gone[edge]], stop[gone[edge]]
                r_doc.append(d[some][row[edge]])
                r_lo.append(lo[some][row[edge]] + step[edge])
                r_hi.append(lo[some][row[edge]] + step[stop] + window)
            r_doc, r_lo, r_hi = (np.concatenate(x) for x in (r_doc, r_lo, r_hi))
            order = np.lexsort((r_lo, r_doc))
            blobs.append(pack(keys[r_doc[order]], r_lo[order].astype(np.int32), r_hi[order].astype(np.int32))
                         if len(order) else None)
        out = pa.table({"blk": table.column("blk"), "ranges": pa.array(blobs, pa.binary())})
        return out.filter(out.column("ranges").is_valid())

    sent = dealt.groupBy("blk").applyInArrow(anchors, "bucket long, blk long, anchors binary, more binary")
    answers = sent.groupBy("bucket").applyInArrow(shared, "blk long, bucket long, bits binary, hot binary")
    cut = dealt.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(
        segments, "bucket long, blk long, docs binary, uses binary, texts binary")
    return cut.groupBy("bucket").applyInArrow(index, "blk long, ranges binary")


def with_ranges(dealt: DataFrame, ranges: DataFrame, unit: str, finish, schema: str) -> DataFrame:
    """Unite the ranges per document and let ``finish(units, removed mask, piece)`` make its rows."""

    def unite(_, table: pa.Table, replies: pa.Table) -> pa.Table:
        got = [unpack(x, np.uint64, np.int32, np.int32) for x in replies.column("ranges").to_pylist()]
        key, lo, hi = ((np.concatenate([g[i] for g in got]) for i in range(3)) if got else
                       (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)))
        order = np.argsort(key)
        key, lo, hi = key[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        out = []
        for piece in block_pieces(table) if table.num_rows else []:
            u = Units(piece, unit, 1, 1, anchors=False)
            a, b = np.searchsorted(key, u.key, "left"), np.searchsorted(key, u.key, "right")
            row = np.repeat(np.arange(len(u.key)), b - a)
            pick = _take(np.arange(len(key)), a, b)
            gone = S.covered(u.first, lo[pick] + u.first[row], hi[pick] + u.first[row], int(u.first[-1]))
            out.append(finish(u, gone, piece))
        return pa.Table.from_batches(out) if out else pa.table({})

    return dealt.groupBy("blk").cogroup(ranges.groupBy("blk")).applyInArrow(unite, schema)
