"""Line dedup by pairwise alignment of overlapping documents.

A document is its sequence of line hashes (lines without surrounding blanks).  Equal sequences are
collapsed: only the one with the smallest doc_id is aligned, later copies lose all their lines.
Overlapping documents are found through shared rare lines: a line of at least ``min_line``
characters that at least two sequences hold and that is rare for its document - among the rarer half
of the document's own lines, whatever its number of holders.  All other lines link by runs: the
shortest runs of consecutive lines from a line on and up to a line that have ``min_block`` characters
(a long line is a run of its own), however many sequences hold them.  As every line of a deletable
block is in such a run inside the block, no number of holders hides one.  A sequence is paired with the earliest holder of each of its rare
lines and of each of its runs, so pairs grow with lines and a group of any size is a star, never all
pairs.

Each pair is aligned by patience diff: common ends are matched, then lines that are unique in both
and in increasing order split the rest, recursively; a stretch without such lines (repeated lines)
is aligned by a longest common subsequence in memory of the order of its lines.  Maximal blocks of
aligned lines with at least ``min_block`` characters are deleted from the later document.

Cases: a null text has no lines and stays null, an empty one has one blank line; blank lines count
in blocks but have no characters and link nothing; repeated rows of one id are not later than each
other and get the same result; rows with a null doc_id take no part and keep everything; empty
tables and extra columns are fine.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsdesk.llm import textscan as S
from opsdesk.llm.common import map_pieces, prepare, releasing, stored

MIN_LINE = 20                # characters of a linking line
MIN_BLOCK = 40               # characters of a deleted block
ALIGN_LINES = 100_000        # lines of the pairs turned into Python lists at once


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
        back[i] = at[p - 1] if p else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _reach(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of a longest common subsequence of ``a`` with every prefix of ``b`` (bit-parallel: one
    big integer holds a row of the table)."""
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & match.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[:len(b)].astype(np.int64))])


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order, by halving ``a`` where both halves'
    subsequences are longest (so memory stays of the order of the sequences)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            at = next((j for j in range(b0, b1) if b[j] == a[a0]), None)
            if at is not None:
                out.append((a0, at))
            continue
        mid = (a0 + a1) // 2
        left = _reach(a[a0:mid], b[b0:b1])
        right = _reach(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(left + right))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences by patience diff, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, int] = {}
        for i in range(a0, a1):
            place[a[i]] = i if a[i] not in place else -1
        mine: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in place:
                mine[b[j]] = j if b[j] not in mine else -1
        unique = [(j, place[x]) for x, j in mine.items() if j >= 0 and place[x] >= 0]
        if not unique:
            if mine:                          # common lines, all of them repeated
                out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        unique.sort()
        chain = [unique[i] for i in increasing([i for _, i in unique])]
        i0, j0 = a0, b0
        for j, i in chain:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    out.sort()
    return out


def deleted_lines(early: list[int], late: list[int], size: list[int], min_block: int) -> list[int]:
    """Line indices of ``late`` in aligned common blocks of at least ``min_block`` characters."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(early, late), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if block and sum(size[x] for x in block) >= min_block:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def line_runs(h: np.ndarray, c: np.ndarray, off: np.ndarray, min_block: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, hash) of the distinct runs of sequences of line hashes ``h`` and lengths ``c``; a
    sequence is [off[i], off[i + 1])."""
    chars = np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
    at = np.flatnonzero(c > 0)
    seq = np.searchsorted(off, at, side="right") - 1
    end = np.searchsorted(chars, chars[at] + min_block)                            # from a line on
    begin = np.searchsorted(chars, chars[at + 1] - min_block, side="right") - 1    # up to a line
    on, upto = end <= off[seq + 1], begin >= off[seq]
    begin, end, seq = (np.concatenate(x) for x in ((at[on], begin[upto]), (end[on], at[upto] + 1), (seq[on], seq[upto])))
    run = S.range_hash(S.prefix_hash(S.mix(h.view(np.uint64))), begin, end)
    order = np.lexsort((run, seq))
    seq, run = seq[order], run[order]
    new = np.concatenate([[True], (seq[1:] != seq[:-1]) | (run[1:] != run[:-1])])[:len(seq)]
    return seq[new], run[new]


def run_pairs(seqs: DataFrame, min_block: int) -> DataFrame:
    """(seq_key, hub): every sequence with the earliest holder of each of its shared runs."""
    def cut(batches):
        for b in batches:
            h, c = b.column("h"), b.column("c")
            seq, run = line_runs(h.flatten().to_numpy(), c.flatten().to_numpy(),
                                 np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy(), dtype=np.int64)]), min_block)
            pick = pa.array(seq)
            yield pa.RecordBatch.from_arrays([b.column("seq_key").take(pick), b.column("doc").take(pick),
                                              pa.array(run.view(np.int64))], names=["seq_key", "doc", "run"])

    runs = seqs.select("seq_key", "doc", "h", "c").mapInArrow(releasing(cut), "seq_key long, doc long, run long")
    # written, so that both sides of the join are dealt anew and the rows of a hot run are split
    holders = stored(runs.groupBy("run").agg(F.count("*").alias("df"), F.min(F.struct("doc", "seq_key")).alias("hub"))
                     .where("df > 1").select("run", F.col("hub.seq_key").alias("hub")), "run-holders")
    return runs.join(holders, "run").where("hub <> seq_key").select("seq_key", "hub").distinct()


def repeated_lines(rows: DataFrame, min_line: int = MIN_LINE, min_block: int = MIN_BLOCK
                   ) -> tuple[DataFrame, DataFrame]:
    """From rows of (doc_id, text): (sequences, cuts).  sequences: seq_key, first_doc; cuts:
    seq_key and the sorted line indices that its first document loses."""
    lines = rows.where("doc_id is not null and text is not null") \
        .select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)).alias("l")) \
        .select("doc_id", F.transform("l", lambda x: F.xxhash64(x)).alias("h"),
                F.transform("l", lambda x: F.length(x)).alias("c")) \
        .withColumn("seq_key", F.xxhash64("h"))
    seqs = stored(lines.groupBy("seq_key").agg(F.min("doc_id").alias("doc"), F.any_value("h").alias("h"),
                                               F.any_value("c").alias("c")), "sequences")
    held = seqs.select("seq_key", "doc", F.size(F.array_distinct("h")).alias("n"),
                       F.explode(F.array_distinct(F.arrays_zip("h", "c"))).alias("x")) \
        .select("seq_key", "doc", "n", F.col("x.h").alias("line"), F.col("x.c").alias("c")) \
        .where(F.col("c") >= min_line)
    holders = stored(held.groupBy("line").agg(F.count("*").alias("df"), F.min(F.struct("doc", "seq_key")).alias("hub"))
                     .where("df > 1").select("line", "df", F.col("hub.seq_key").alias("hub")), "line-holders")
    shared = held.join(holders, "line").select("seq_key", "n", "line", "df", "hub")
    from pyspark.sql.window import Window
    place = F.row_number().over(Window.partitionBy("seq_key").orderBy("df", "line"))
    number = F.count("*").over(Window.partitionBy("seq_key"))
    ranked = shared.withColumn("rank", F.col("n") - number + place - 1)
    pairs = ranked.where(2 * F.col("rank") < F.col("n")) \
        .where("hub <> seq_key").select("seq_key", "hub").union(run_pairs(seqs, min_block)).distinct()
    early = seqs.select(F.col("seq_key").alias("hub"), F.col("h").alias("early"))
    # the later document's lines travel with it, the hub's are joined (skewed joins are split)
    both = pairs.join(seqs.select("seq_key", F.col("h").alias("late"), "c"), "seq_key").join(early, "hub")

    def align(batches):
        for b in batches:
            lines = np.cumsum(b.column("early").value_lengths().to_numpy() + b.column("late").value_lengths().to_numpy(),
                              dtype=np.int64)
            i = 0
            while i < b.num_rows:              # Python lists of some pairs at a time
                j = max(i + 1, int(np.searchsorted(lines, (lines[i - 1] if i else 0) + ALIGN_LINES, side="right")))
                some = b.slice(i, j - i)
                cut = [deleted_lines(x, y, c, min_block) for x, y, c in
                       zip(*(some.column(k).to_pylist() for k in ("early", "late", "c")))]
                yield pa.RecordBatch.from_arrays([some.column("seq_key"), pa.array(cut, pa.list_(pa.int32()))],
                                                 names=["seq_key", "cut"])
                i = j

    cuts = both.select("seq_key", "early", "late", "c").mapInArrow(releasing(align), "seq_key long, cut array<int>") \
        .where(F.size("cut") > 0).groupBy("seq_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))
    return seqs.select("seq_key", F.col("doc").alias("first_doc")), cuts


def remove_repeated_lines(docs: DataFrame, keep: list[str] | None = None,
                          min_line: int = MIN_LINE, min_block: int = MIN_BLOCK) -> DataFrame:
    """The columns of ``keep`` (doc_id and text among them), text without the deleted lines, with
    n_lines, n_removed and kept_sha256 (of the kept lines joined by line feeds)."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id", "text"]
    frame = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in keep])
    seqs, cuts = repeated_lines(frame.select("doc_id", "text"), min_line, min_block)
    verdict = seqs.join(cuts, "seq_key", "left").withColumnsRenamed(
        {"seq_key": "_seq", "first_doc": "_first", "cut": "_cut"})
    keyed = frame.withColumn("_seq", F.when(F.col("doc_id").isNotNull(), F.xxhash64(
        F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(F.trim(x))))))
    joined = keyed.join(verdict, "_seq", "left").select(*keep, F.col("doc_id").alias("_id"), "_first", "_cut")

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column("text").to_pylist()
        ids, first, cuts_ = (piece.column(c).to_pylist() for c in ("_id", "_first", "_cut"))
        out, n_lines, n_removed, sha = [], [], [], []
        for text, i, f, c in zip(texts, ids, first, cuts_):
            if text is None:
                kept, n, gone = None, 0, 0
            else:
                n = text.count("\n") + 1
                if i is not None and f is not None and i > f:
                    kept, gone = "", n
                elif c:
                    drop = set(c)
                    kept = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in drop)
                    gone = len(drop)
                else:
                    kept, gone = text, 0
            out.append(kept)
            n_lines.append(n)
            n_removed.append(gone)
            sha.append(hashlib.sha256((kept or "").encode("utf-8")).hexdigest())
        cols = [pa.array(out, pa.string()) if c == "text" else piece.column(c) for c in keep]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
            names=[*keep, "n_lines", "n_removed", "kept_sha256"])

    schema = T.StructType([*frame.schema.fields, T.StructField("n_lines", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return map_pieces(joined, cut, schema)
