"""Token counts: offset-mapped attribution of whole-document tokens to sections.

Every document is encoded once as a whole (byte-level BPE).  A token's bytes are known from the
vocabulary, so running byte lengths give exact offsets, mapped to characters.  Token spans are
joined with the section spans of their document by interval (binary search on both ends) and a
token that crosses a boundary is allocated by an explicit rule:

* ``largest`` (default): the section with the largest overlap in characters, ties to the earlier;
* ``first``: the section holding the token's first character;
* ``last``: the section holding the token's last character.

A token that overlaps no section (a gap between given sections) goes to the nearest section that
begins before it, or to the first one.  Sections are the lines of the text (each with its line
feed) unless an ``array<struct<start,end>>`` column of character spans is named; given spans are
sorted and must not overlap.  So the counts of a document's sections sum to its token count.

Cases: a null or empty text has one empty section with 0 tokens; repeated rows are counted for
themselves; a document with an empty or null list of given sections gives no rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import id_text, map_pieces, one_thread, prepare

SCHEMA = "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long"
RULES = ("largest", "first", "last")


class ByteBpe:
    """Byte-level BPE from a rank file, with the byte length of every token."""

    def __init__(self, ranks_file: bytes, pattern: str):
        one_thread()
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) }
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset after each token of the text."""
        return np.cumsum(self.size[np.array(self.enc.encode_ordinary(text), np.int64)])


_BPE: dict[int, ByteBpe] = {}


def _bpe(ranks_file: bytes, pattern: str) -> ByteBpe:
    key = hash((ranks_file, pattern))
    if key not in _BPE:
        _BPE[key] = ByteBpe(ranks_file, pattern)
    return _BPE[key]


def allocate(t_start: np.ndarray, t_end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray,
             rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of every token; spans are half-open and sections sorted, disjoint."""
    first = np.searchsorted(s_end, t_start, side="right")           # first section ending after it
    last = np.searchsorted(s_start, t_end, side="left") - 1         # last section starting before
    crosses = last > first
    none = last < first
    nearest = np.maximum(np.searchsorted(s_start, t_start, side="right") - 1, 0)
    if rule == "last":
        pick = last
    else:
        pick = first.copy()
        if rule == "largest":
            for i in np.flatnonzero(crosses):
                a, b = int(first[i]), int(last[i])
                over = np.minimum(s_end[a:b + 1], t_end[i]) - np.maximum(s_start[a:b + 1], t_start[i])
                pick[i] = a + int(np.argmax(over))
    return np.where(none, nearest, pick), crosses


def token_counts(docs: DataFrame, ranks_file: bytes, pattern: str, rule: str = "largest",
                 sections: str | None = None) -> DataFrame:
    """Tokens per section: doc_id, section (from 0), start and n_chars of its span, n_tokens
    allocated to it and n_crossing of those that also overlap another section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((ranks_file, pattern))    # vocabulary: fixed size
    frame = id_text(docs)
    if sections is not None:
        frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").cast("string").alias("text"),
                            F.expr(f"transform(`{sections}`, s -> s.start)").cast("array<long>").alias("s0"),
                            F.expr(f"transform(`{sections}`, s -> s.end)").cast("array<long>").alias("s1"))

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(*shared.value)
        data, off = S.text_bytes(piece.column("text"))
        # characters before each byte: continuation bytes (10xxxxxx) start none
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        newline = np.flatnonzero(data == 0x0A)
        ids = piece.column("doc_id").to_pylist()
        texts = piece.column("text").to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for d, text in enumerate(texts):
            a, b = int(off[d]), int(off[d + 1])
            base = chars[a]
            if sections is None:
                cut = newline[np.searchsorted(newline, a):np.searchsorted(newline, b)] + 1
                marks = np.concatenate([[a], cut[cut < b], [b]]) if b > a else np.array([a, a])
                s0, s1 = chars[marks[:-1]] - base, chars[marks[1:]] - base
            else:
                s0 = np.array(piece.column("s0")[d].as_py() or [], np.int64)
                s1 = np.array(piece.column("s1")[d].as_py() or [], np.int64)
                order = np.argsort(s0, kind="stable")
                s0, s1 = s0[order], s1[order]
            m = len(s0)
            if m == 0:
                continue
            tokens, crossing = np.zeros(m, np.int64), np.zeros(m, np.int64)
            if b > a:
                ends = bpe.ends(text)
                starts = np.concatenate([[0], ends[:-1]])
                t0 = chars[a + starts + 1] - 1 - base
                t1 = chars[a + ends] - base
                where, crosses = allocate(t0, t1, s0, s1, rule)
                tokens = np.bincount(where, minlength=m)
                crossing = np.bincount(where[crosses], minlength=m)
            for column, values in zip(out, (np.full(m, -1), np.arange(m), s0, s1 - s0, tokens, crossing)):
                column.append(values)
            out[0][-1] = pa.array([ids[d]] * m, pa.int64())
        if not out[0]:
            return None
        arrays = [pa.concat_arrays(out[0])] + [pa.array(np.concatenate(c).astype(np.int64)) for c in out[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "n_chars",
                                                         "n_tokens", "n_crossing"])

    return map_pieces(frame, count, SCHEMA)
