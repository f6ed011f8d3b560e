"""Whole-text token ids of the lower-casing word BPE, encoding each distinct word once.

The tokenizer drops white space and never merges across it, and its pre-tokenizer cuts a text
into runs of letters, single digits and runs of other characters.  A text's ids are therefore
the concatenation of the ids of those parts.  Parts made of ASCII and Latin-1 characters are cut
with array operations and encoded by the tokenizer's own BPE model; a white-space separated
chunk holding anything else (other scripts, apostrophes, control characters, special-token
marks) goes through the complete tokenizer.  Both are remembered per worker, so work grows with
distinct words and array passes only.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from opsdesk.llm import textscan as S
from opsdesk.llm.common import one_thread

_SPACE, _LETTER, _DIGIT, _OTHER, _SLOW = 0, 1, 2, 3, 4
CACHE_WORDS = 1_000_000        # remembered parts per Python worker before the cache starts anew


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SLOW, np.uint8)
    out[0x21:0x7F] = _OTHER
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[ord("'")] = _SLOW                    # contractions have rules of their own
    out[0x20] = _SPACE
    out[0x09:0x0E] = _SPACE
    return out


def _byte_letters() -> np.ndarray:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    out = np.arange(256, dtype="<u2")
    out[rest] = 256 + np.arange(len(rest))
    return out


class KeySlots:
    """64-bit keys to slots, as two sorted arrays: a large one and a small one of recent keys that is
    merged into it from time to time (12 bytes a key)."""

    def __init__(self):
        self.parts = [(np.empty(0, np.uint64), np.empty(0, np.int32))] * 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the sorted ``keys``, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """New keys, sorted."""
        large, recent = self.parts
        recent = self._merged(recent, (keys, slots.astype(np.int32)))
        if len(recent[0]) > max(1 << 15, len(large[0]) >> 3):
            large, recent = self._merged(large, recent), (keys[:0], np.empty(0, np.int32))
        self.parts = [large, recent]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


class WordBpe:
    def __init__(self, spec: bytes):
        one_thread()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec.decode("utf-8"))
        self.model = self.tok.model
        self.classes = _byte_classes()
        self.letters = _byte_letters()
        self.special = any(t.content.startswith("<|") for t in self.tok.get_added_tokens_decoder().values())
        self._reset()

    def _reset(self) -> None:
        self.slots = KeySlots()
        self.known = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Remember the ids of new keys in the slots known, known + 1, ..."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        base = self.known
        while base + len(keys) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        self.start[base:base + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.size[base:base + len(keys)] = lengths
        self.used += len(flat)
        self.slots.add(keys, np.arange(base, base + len(keys)))
        self.known += len(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): all token ids of the texts one after another and, per text, where its
        ids begin (length texts + 1)."""
        n = len(data)
        docs = len(offsets) - 1
        if n == 0:
            return np.empty(0, np.uint32), np.zeros(docs + 1, np.int64)
        cls = self.classes[data]
        # two-byte Latin-1 letters: C3 80..BF without the signs x (97) and /
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < n]
        nxt = data[lead + 1]
        good = lead[(nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)]
        cls[good] = _LETTER
        cls[good + 1] = _LETTER
        low = data.copy()
        cap = (data >= 0x41) & (data <= 0x5A)
        low[cap] += 0x20
        up = good[data[good + 1] <= 0x9E]
        low[up + 1] += 0x20
        if self.special:
            mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
            cls[mark] = _SLOW
        # white-space chunks; a chunk with any slow byte is encoded whole
        cs, ce, _ = S.words(data, offsets)
        if not len(cs):
            return np.empty(0, np.uint32), np.zeros(docs + 1, np.int64)
        slow_at = np.concatenate([[0], np.cumsum(cls == _SLOW)])
        slow = slow_at[ce] > slow_at[cs]
        inside = np.zeros(n + 1, np.int8)
        inside[cs[slow]] = 1
        inside[ce[slow]] -= 1
        in_slow = np.cumsum(inside[:n], dtype=np.int8) > 0
        begin = (cls != _SPACE) & ~in_slow
        same = np.zeros(n, bool)
        same[1:] = (cls[1:] == cls[:-1]) & (cls[1:] != _DIGIT)
        chunk_start = np.zeros(n, bool)
        chunk_start[cs] = True
        begin &= ~same | chunk_start
        begin[cs[slow]] = True
        starts = np.flatnonzero(begin)
        # a part ends at the next part of its chunk or at the chunk's end
        ends = ce[np.searchsorted(cs, starts, side="right") - 1].copy()
        if len(starts) > 1:
            ends[:-1] = np.minimum(ends[:-1], starts[1:])
        raw = in_slow[starts]
        hash_low = S.prefix_hash(S.BYTE_CODE[low])
        key = S.range_hash(hash_low, starts, ends)
        if raw.any():
            hash_raw = S.prefix_hash(S.BYTE_CODE[data])
            key[raw] = S.mix(S.range_hash(hash_raw, starts[raw], ends[raw]) ^ S.U64(0x5851F42D4C957F2D))
        uniq, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        slots = self._slots(uniq, where, starts, ends, raw, data, low)
        part = slots[inverse]
        length = self.size[part]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[part] - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets, side="left")]

    def _slots(self, uniq, where, starts, ends, raw, data, low) -> np.ndarray:
        if self.known + len(uniq) > max(CACHE_WORDS, len(uniq)):
            self._reset()
        out = self.slots.find(uniq)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            at = where[missing]
            whole = raw[at]
            raw_bytes = data.tobytes()
            low_text = self.letters[low].tobytes().decode("utf-16-le")    # one letter a byte
            s, e = starts[at].tolist(), ends[at].tolist()
            token = self.model.tokenize
            texts = [raw_bytes[s[i]:e[i]].decode("utf-8", "replace") for i in np.flatnonzero(whole)]
            whole_ids = iter(x.ids for x in self.tok.encode_batch(texts, add_special_tokens=False)) \
                if texts else iter(())
            ids = [next(whole_ids) if w else [t.id for t in token(low_text[a:b])]
                   for w, a, b in zip(whole.tolist(), s, e)]
            out[missing] = np.arange(self.known, self.known + len(missing))
            self._add(uniq[missing], ids)
        return out
