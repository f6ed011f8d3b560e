"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised alike (A-Z lower-cased; words are runs of ASCII letters,
digits and non-ASCII bytes).  The items' word sequences build one generalised suffix automaton;
training text is streamed through it, keeping for every word the automaton state and the longest
match ending there.  A word is hit if it lies in an occurrence of a window: ``window``
consecutive words of an item, or a whole item of fewer words.

The automaton lives in arrays and advances many text runs at once (one numpy step per word
position).  Only runs that can hold a window enter it: consecutive words whose every neighbouring
pair occurs in some item, at least as long as the shortest window; nothing else can match.

Items are a stated query set.  They are handled in blocks of at most ``block_bytes`` of text, so
memory and the broadcast automaton stay bounded however large the benchmark is; hits of the
blocks are united per document.

Cases: null or empty texts and items have no words and no window; equal items are all reported;
an item with a null id takes no part; repeated documents are rows of their own; empty tables and
extra columns are fine.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsdesk.llm import textscan as S
from opsdesk.llm.common import carry, id_text, map_pieces, prepare, restore

ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def item_words(text: str | None) -> list[bytes]:
    return ITEM_WORD.findall((text or "").encode("utf-8").lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences (online construction)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._state(self.len[last] + 1, {}, -1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self.extend(last, c)


class ItemIndex:
    """The automaton of one block of items, as arrays that a task can stream text through."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        items = [(i, w) for i, w in items if w]
        vocab = sorted({w for _, ws in items for w in ws})
        data = np.frombuffer(b"".join(vocab), np.uint8)
        ends = np.cumsum([len(w) for w in vocab]).astype(np.int64) if vocab else np.empty(0, np.int64)
        starts = ends - np.array([len(w) for w in vocab], np.int64) if vocab else ends
        hashes = S.range_hash(S.prefix_hash(S.BYTE_CODE[data]), starts, ends)
        order = np.argsort(hashes)
        self.word_hash = hashes[order]
        code = {w: int(c) for c, w in zip(np.argsort(order), vocab)}
        seqs = [[code[w] for w in ws] for _, ws in items]
        sam = SuffixAutomaton()
        for seq in seqs:
            sam.add(seq)
        self.length = np.array(sam.len, np.int64)
        self.link = np.array(sam.link, np.int64)
        self.words = max(1, len(vocab))
        keys, targets = [], []
        for s, nxt in enumerate(sam.next):
            for c, t in nxt.items():
                keys.append(s * self.words + c)
                targets.append(t)
        keys = np.array(keys, np.int64)
        o = np.argsort(keys)
        self.edge, self.target = keys[o], np.array(targets, np.int64)[o]
        pairs = {a * self.words + b for seq in seqs for a, b in zip(seq, seq[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        # windows: by length, the state of each window and its items
        self.windows = []
        self.shortest = min((min(len(q), window) for q in seqs), default=0)
        for n in sorted({min(len(q), window) for q in seqs}):
            home = self._ancestors(n)
            found: dict[int, set[int]] = {}
            for (item, _), seq in zip(items, seqs):
                if min(len(seq), window) != n:
                    continue
                state = 0
                for at, c in enumerate(seq):
                    state = sam.next[state][c]
                    if at + 1 >= n:
                        found.setdefault(int(home[state]), set()).add(item)
            has = np.zeros(len(self.length), bool)
            has[list(found)] = True
            self.windows.append((n, home, has, {s: sorted(v) for s, v in found.items()}))

    def _ancestors(self, n: int) -> np.ndarray:
        """Per state of length >= n the suffix-link ancestor that holds the suffix of length n."""
        home = np.arange(len(self.length))
        while True:
            up = self.link[home]
            move = (up >= 0) & (self.length[np.maximum(up, 0)] >= n)
            if not move.any():
                return home
            home = np.where(move, up, home)

    def step(self, state: np.ndarray, match: np.ndarray, word: np.ndarray) -> None:
        """Advance every lane by one word, in place: shorten by suffix links until it fits."""
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[at] == key
            go = todo[ok]
            state[go] = self.target[at[ok]]
            match[go] += 1
            rest = todo[~ok]
            up = self.link[state[rest]]
            dead = up < 0
            match[rest[dead]] = 0
            rest, up = rest[~dead], up[~dead]
            state[rest] = up
            match[rest] = self.length[up]
            todo = rest

    def scan(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stream word hashes of documents [first[d], first[d+1]): (hit mask of the words,
        document and item of every occurring (document, item))."""
        n = len(hashes)
        hit = np.zeros(n, bool)
        none = np.empty(0, np.int64)
        if n == 0 or not len(self.word_hash):
            return hit, none, none
        at = np.minimum(np.searchsorted(self.word_hash, hashes), len(self.word_hash) - 1)
        known = self.word_hash[at] == hashes
        word = np.where(known, at, -1)
        joined = np.zeros(n, bool)                      # joined to the word before it
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs) and len(both):
            key = word[both - 1] * self.words + word[both]
            p = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[p] == key]] = True
        joined[first[(first > 0) & (first < n)]] = False
        run = np.flatnonzero(known & ~joined)
        if not len(run):
            return hit, none, none
        stop = np.flatnonzero(known & np.append(~joined[1:], True)) + 1
        keep = stop - run >= self.shortest
        run, stop = run[keep], stop[keep]
        order = np.argsort(run - stop, kind="stable")   # longest first: live lanes are a prefix
        run, stop = run[order], stop[order]
        size = stop - run
        doc = np.searchsorted(first, run, side="right") - 1
        state, match = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
        diff = np.zeros(n + 1, np.int64)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            self.step(state[:live], match[:live], word[run[:live] + t])
            for w, (length, home, has, _) in enumerate(self.windows):
                full = np.flatnonzero(match[:live] >= length)
                full = full[has[home[state[full]]]]
                if len(full):
                    np.add.at(diff, run[full] + t + 1 - length, 1)
                    np.add.at(diff, run[full] + t + 1, -1)
                    seen.append((doc[full], home[state[full]] * len(self.windows) + w))
        hit = np.cumsum(diff[:n]) > 0
        if not seen:
            return hit, none, none
        pairs = np.unique(np.stack([np.concatenate([a for a, _ in seen]),
                                    np.concatenate([b for _, b in seen])], 1), axis=0)
        out = {(int(d), i) for d, s in pairs for i in self.windows[s % len(self.windows)][3][s // len(self.windows)]}
        docs, ids = zip(*sorted(out))
        return hit, np.array(docs, np.int64), np.array(ids, np.int64)


def item_blocks(items: DataFrame, block_bytes: int):
    """Items in blocks of bounded text size (a stated query set, read block by block)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("item_id is not null and text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        ws = item_words(row["text"])
        block.append((row["item_id"], ws))
        size += len(row["text"]) + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10,
                       block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, remove: bool = False) -> DataFrame:
    """Per document: the columns of ``keep`` (doc_id), n_words, n_hit and item_ids (array, sorted).
    With ``remove`` the kept text comes without the hit words (their bytes are cut, everything
    else stays).

    Every block of items is one automaton in the tasks' closure; a document is streamed through
    each of them, and its hits are united before anything is returned.
    """
    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(ItemIndex(b, window)) for b in item_blocks(items, block_bytes)]
    keep = keep or ["doc_id"]
    frame = docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("text", F.col("text").cast("string"))
    names = [*keep, "n_words", "n_hit", "item_ids"]
    schema = T.StructType([*(frame.schema[c] for c in keep), T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType()))])

    def scan(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, off = S.text_bytes(piece.column("text"))
        low = LOWER[data]
        starts, ends, first = S.words(low, off, S.ALNUM_WORDS)
        hashes = S.range_hash(S.prefix_hash(S.BYTE_CODE[low]), starts, ends)
        hit = np.zeros(len(starts), bool)
        found: dict[int, set[int]] = {}
        for block in shared:
            h, d, i = block.value.scan(hashes, first)
            hit |= h
            for a, b in zip(d.tolist(), i.tolist()):
                found.setdefault(a, set()).add(b)
        total = np.concatenate([[0], np.cumsum(hit)])
        m = piece.num_rows
        kept = {c: piece.column(c) for c in keep}
        if remove and hit.any():
            texts = piece.column("text").to_pylist()
            for d in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
                at = first[d] + np.flatnonzero(hit[first[d]:first[d + 1]])
                spans = zip((starts[at] - off[d]).tolist(), (ends[at] - off[d]).tolist())
                texts[d] = _cut(texts[d].encode("utf-8"), spans)
            kept["text"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(
            [*(kept[c] for c in keep), pa.array(first[1:] - first[:-1]), pa.array(total[first[1:]] - total[first[:-1]]),
             pa.array([sorted(found.get(d, ())) for d in range(m)], pa.list_(pa.int64()))], names=names)

    return map_pieces(frame, scan, schema)


def _cut(raw: bytes, spans) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the spans that occur in test items; those of which more than
    ``max_coverage`` of the words are hit go as a whole."""
    found = find_contamination(carry(docs), items, window, keep=["text", "row"], remove=True)
    return restore(found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage)), docs)


def contamination_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The digest columns of the registered query."""
    found = find_contamination(id_text(docs), items, window)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
