"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document is encoded once and cut into pieces of at most ``capacity`` tokens (full pieces and
one remainder).  Pieces are dealt at random (by a hash) into groups of bounded size; each group is
packed independently by first-fit decreasing.  A tournament tree over bin capacities finds the
leftmost bin with enough room in O(log bins).  Groups are numerous and of equal expected size, so
a hot source or a group of copies never meets in one task; nothing is collected.

Cases: null text is an empty text (its only token is ``eos``); repeated rows are documents of
their own; an empty table gives an empty result; a null doc_id stays null; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import id_text, pieces, prepare, releasing, stored

GROUP_PIECES = 16_384      # expected pieces of a group: bounds memory of a packing task
ENCODE_BYTES = 1 << 19     # text encoded at once: about a hundred bytes of arrays per byte of text

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree over bins: every inner node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the leftmost bin that has room; the bin's index."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        at = node - self.leaves
        node //= 2
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            best = left if left >= right else right
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size; sizes are at most ``capacity``, ties keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    tree = CapacityTree(len(sizes), capacity)
    fill: list[int] = [0] * len(sizes)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        b = tree.place(size)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
    return bins, offsets


def piece_batches(batches, spec: bytes, capacity: int, eos: int, emit_ids: bool = False):
    """Token pieces of Arrow batches with doc_id and text (runs inside a task)."""
    from opsdesk.llm.wordbpe import WordBpe
    bpe = worker_tokenizer(spec, WordBpe)
    for batch in batches:
        for piece in pieces(batch, limit=ENCODE_BYTES):
            yield _cut(piece, bpe, capacity, eos, emit_ids)


def _cut(piece: pa.RecordBatch, bpe, capacity: int, eos: int, emit_ids: bool) -> pa.RecordBatch:
    ids, first = bpe.encode(*S.text_bytes(piece.column("text")))
    docs = len(first) - 1
    total = np.diff(first) + 1                       # with eos
    stop = np.cumsum(total)
    whole = np.full(stop[-1], eos, "<u4")
    inner = np.ones(len(whole), bool)
    inner[stop - 1] = False
    whole[inner] = ids
    parts = -(-total // capacity)
    doc = np.repeat(np.arange(docs), parts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
    length = np.minimum(capacity, total[doc] - start)
    at = (stop - total)[doc] + start
    raw = memoryview(whole).cast("B")
    crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())),
                      np.int64, len(doc))
    arrays = [piece.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc),
              pa.array(total[doc])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if emit_ids:
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.astype(np.int64))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def encode_pieces(docs: DataFrame, spec: bytes, capacity: int = 2048, eos: int = 1,
                  emit_ids: bool = False) -> DataFrame:
    """Token pieces of every document: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(spec)      # the vocabulary file: fixed size
    schema = PIECE_SCHEMA + (", ids array<long>" if emit_ids else "")
    return id_text(docs).mapInArrow(
        releasing(lambda batches: piece_batches(batches, shared.value, capacity, eos, emit_ids)), schema)


_TOKENIZER: dict[int, object] = {}


def worker_tokenizer(spec: bytes, kind):
    """One tokenizer with its cache of words per Python worker."""
    key = zlib.crc32(spec)
    if key not in _TOKENIZER:
        _TOKENIZER[key] = kind(spec)
    return _TOKENIZER[key]


def pack_documents(docs: DataFrame, spec: bytes, capacity: int = 2048, eos: int = 1,
                   group_pieces: int = GROUP_PIECES, emit_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids with ``emit_ids``).  sequence_id is group * 2**32 + bin; offsets are gapless from 0.
    """
    parts = stored(encode_pieces(docs, spec, capacity, eos, emit_ids), "pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    extra = ["ids"] if emit_ids else []

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        grp = group.column("grp").to_numpy()
        out = [group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out += [pa.array((grp << 32) + bins), pa.array(offsets)]
        return pa.table(out + [group.column(c) for c in extra], names=names + extra)

    schema = PIECE_SCHEMA + ", sequence_id long, offset long" + (", ids array<long>" if emit_ids else "")
    return dealt.groupBy("grp").applyInArrow(pack, schema)
