"""Phrase collocation mining by SON partitioning.

A phrase is 1 to 4 words that follow each other inside a piece of a text; phrases are told apart per
language.  A *shard* is a run of whole texts that one task holds at a time.  If a phrase occurs
``support`` times in all, then some shard holds at least the share of them that equals the shard's
share of its language's bytes.  So every shard is mined completely at its own proportionally lowered
support, and the union of what is locally frequent misses nothing.  ``LOWERED`` lowers it further:
all shards together can then leave at most support / LOWERED occurrences of a phrase unreported, so
the union is hardly larger than the result, and beyond a few shards the local support is one, so the
work per byte is the same at any size:

1. **sizes**: bytes per language (JVM);
2. **pairs**: every shard reports the pairs that reach its local support, with their counts;
3. **union**: a shard that does not report a phrase holds fewer than its local support; over all
   shards that is less than support / LOWERED, so phrases reported too rarely to reach ``support`` go;
4. **longer**: the same for 3 and 4 words, over places where all pairs are candidates and, inside
   the shard, all shorter phrases are locally frequent;
5. **count**: all candidates and their words are counted exactly over all texts.

What tasks report goes by ranges of the phrase hash, packed: one row per shard and range, so Spark moves
few rows, and a range is united by one sort.  The number of ranges grows with the input
(``RANGE_BYTES`` of text each), so a range has a bounded size; a frequent phrase is one entry per shard.
Candidates are handed to the tasks as a bitmap of fixed size (2**``BITS`` bits) over 64-bit phrase
hashes.  A bit that two phrases share only costs work: what does not reach ``support`` is dropped by
its exact count, which is made by the phrase itself, so results are exact at any number of candidates.
Shards are as large as memory allows (``SHARD_BYTES``).

Cuts, scores and the containment rule are joins of the phrase table with itself, with decimal
arithmetic.  Parts of phrases are hot keys (a frequent word begins many phrases); their rows are
salted, the counts replicated ``SALTS`` times.

Cases: null texts are empty; a null language is ``und``, together with documents so marked; repeated
rows count for themselves; texts without a phrase of the support give no rows; an empty table gives
an empty result; a text of any length is one run of words; doc_id and extra columns are not read.
Ties are ranked by phrase in byte order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.llm import textscan as S
from opsdesk.llm.common import pieces, prepare, releasing, stored

LONGEST = 4
BITS = 26                     # bitmap of 2**26 bits: 8 MB
SHARD_BYTES = 64 << 20        # text of a shard
COUNT_BYTES = 4 << 20         # text counted at once in the exact step
PIECE = 1 << 20               # text cut into words at once
LOWERED = 16                  # local support is the shard's share of support / LOWERED
RANGE_BYTES = 16 << 20        # text whose phrases make one range of hashes (256 ranges at least)
GROUPS = 1 << 16              # languages are hashed to so many groups of shares
SALTS = 16

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15 | 1)

# word bytes: all but blanks and the delimiters of pieces
PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORDS = ~PIECE_END
WORDS[[0x20, 0x09]] = False


# ----------------------------------------------------------------------------- words of a piece
class Words:
    """Words of an Arrow slice with columns text, lang, grp: hashes (of word and language), whether
    the next word follows in the same piece, and the language group."""

    def __init__(self, piece: pa.RecordBatch, keep_text: bool = False):
        data, off = S.text_bytes(piece.column("text"))
        low = data.copy()
        low[(data >= 0x41) & (data <= 0x5A)] += 0x20
        starts, ends, first = S.words(low, off, WORDS)
        self.docs = len(off) - 1
        self.doc = np.repeat(np.arange(self.docs, dtype=np.int32), np.diff(first))
        lang, at = S.text_bytes(piece.column("lang"))
        # mixed once more: a word spelled like its language must not cancel out
        lang_hash = S.mix(S.range_hash(S.prefix_hash(S.BYTE_CODE[lang]), at[:-1], at[1:]) + U64(1))
        self.hash = S.mix(S.range_hash(S.prefix_hash(S.BYTE_CODE[low]), starts, ends) ^ lang_hash[self.doc])
        breaks = np.concatenate([[0], np.cumsum(PIECE_END[low], dtype=np.int32)])
        self.joined = np.zeros(len(starts), bool)
        if len(starts) > 1:
            self.joined[:-1] = (breaks[ends[:-1]] == breaks[starts[1:]]) & (self.doc[:-1] == self.doc[1:])
        self.group = np.asarray(piece.column("grp"), np.int32)[self.doc]
        if keep_text:
            self.low, self.starts, self.ends = low, starts, ends


    @classmethod
    def joint(cls, parts: list[Words]) -> Words:
        """The words of several slices (made with their texts), one after another."""
        out = cls.__new__(cls)
        at = np.cumsum([0] + [len(p.low) for p in parts])
        docs = np.cumsum([0] + [p.docs for p in parts])
        out.low = np.concatenate([p.low for p in parts])
        out.starts = np.concatenate([p.starts + a for p, a in zip(parts, at)])
        out.ends = np.concatenate([p.ends + a for p, a in zip(parts, at)])
        out.doc = np.concatenate([p.doc + d for p, d in zip(parts, docs)])
        out.hash = np.concatenate([p.hash for p in parts])
        out.joined = np.concatenate([p.joined for p in parts])
        return out


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n words from every position (those that have n - 1 words behind them)."""
    m = len(word) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = word[:m].copy()
        for i in range(1, n):
            out *= _STEP
            out += word[i:i + m]
        out += U64(n)
    return S.mix(out)


def runs(flags: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` flags in a row are set from every position on."""
    m = max(0, len(flags) - n + 1)
    out = flags[:m].copy()
    for i in range(1, n):
        out &= flags[i:i + m]
    return out


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> U64(64 - BITS)
    return (bitmap[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0


def counted(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys that occur at least ``least`` times, and how often; sorts ``keys`` in place."""
    keys.sort()
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(head, append=len(keys))
    often = times >= least
    return keys[head[often]], times[often]


# ----------------------------------------------------------------------------- mining of a shard
MINED = "range int, keys binary, excess binary"
PARTS = 4                     # parts of the pair hashes that a shard sorts one after another


def grams_at(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``grams`` at some positions only."""
    with np.errstate(over="ignore"):
        out = word[at]
        for i in range(1, n):
            out *= _STEP
            out += word[at + i]
        out += U64(n)
    return S.mix(out)


def _mine_pairs(parts: list, least: int, bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Locally frequent pairs of the parts (word hashes, joined flags) of a shard; whole texts lie in
    one part."""
    found = []
    for r in range(PARTS):
        some = []
        for word, joined in parts:
            keys = grams(word, 2)[joined[:-1]]
            some.append(keys[keys >> U64(62) == U64(r)])
        found.append(counted(np.concatenate(some), least))
    return tuple(np.concatenate(x) for x in zip(*found))


def _mine_longer(parts: list, least: int, bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Locally frequent phrases of three and four words over candidate pairs, and with count 0 the
    words of those pairs: no phrases, but to be counted in the end."""
    places, threes, singles = [], [], []
    for word, joined in parts:
        ok = np.zeros(len(word) + 1, bool)
        ok[:len(word) - 1] = joined[:-1] & marked(bitmap, grams(word, 2))
        begin = np.flatnonzero(ok)
        singles.append(np.unique(grams_at(word, np.concatenate([begin, begin + 1]), 1)))
        places.append(begin[ok[begin + 1]])
        threes.append(grams_at(word, places[-1], 3))
    keys, times = counted(np.concatenate(threes), least)
    fours = []
    for (word, _), place, three in zip(parts, places, threes):
        at = np.minimum(np.searchsorted(keys, three), max(0, len(keys) - 1))
        frequent = np.zeros(len(word) + 1, bool)
        if len(keys):
            frequent[place[keys[at] == three]] = True
        place = np.flatnonzero(frequent[:-1] & frequent[1:])
        fours.append(grams_at(word, place, 4))
    more, more_times = counted(np.concatenate(fours), least)
    single = np.unique(np.concatenate(singles))
    return np.concatenate([keys, more, single]), np.concatenate([times, more_times, np.zeros(len(single), np.int64)])


def hash_ranges(total: int) -> int:
    """Ranges of hashes for ``total`` bytes of text, a power of two."""
    return 1 << max(8, (total // RANGE_BYTES).bit_length())


def range_slices(keys: np.ndarray, ranges: int):
    """(range, from, to) of the sorted ``keys``, without empty ranges."""
    top = (keys >> U64(65 - ranges.bit_length())).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.empty(0, np.int64)
    return zip(top[at].tolist(), at.tolist(), [*at[1:].tolist(), len(top)])


def mine(docs: DataFrame, sizes: np.ndarray, miner, support: int, bitmap=None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Locally frequent phrases of all shards by range: hashes, and for each the local count beyond
    what an unreported phrase could have; -1 marks words to be counted in the end."""
    ranges = hash_ranges(int(sizes.sum()))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((sizes, bitmap))      # both of fixed size

    def run(batches):
        total, bits = shared.value
        held: dict[int, list] = {}
        nbytes: dict[int, int] = {}
        have = 0

        def shard():
            for group, parts in held.items():
                least = max(1, -(-support * nbytes[group] // (LOWERED * int(total[group]))))
                keys, times = miner(parts, least, bits)
                parts.clear()
                order = np.argsort(keys, kind="stable")
                keys, excess = keys[order], np.where(times == 0, -1, times - (least - 1))[order].astype(np.int32)
                rows = [(r, keys[a:b].tobytes(), excess[a:b].tobytes()) for r, a, b in range_slices(keys, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (
                    pa.int32(), pa.binary(), pa.binary()))], names=["range", "keys", "excess"])
            held.clear()
            nbytes.clear()

        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                size = _bytes_by_group(piece)
                words = Words(piece)
                order = np.argsort(words.group, kind="stable")
                present, begin = np.unique(words.group[order], return_index=True)
                for group, at in zip(present.tolist(), np.split(order, begin[1:])):
                    held.setdefault(group, []).append((words.hash[at], words.joined[at]))
                for group, n in size.items():
                    if group in held:
                        nbytes[group] = nbytes.get(group, 0) + n
                have += sum(size.values())
                if have >= shard_bytes:
                    yield from shard()
                    have = 0
        yield from shard()
    return docs.mapInArrow(releasing(run), MINED)


def _bytes_by_group(piece: pa.RecordBatch) -> dict[int, int]:
    _, off = S.text_bytes(piece.column("text"))
    groups = np.asarray(piece.column("grp"), np.int64)
    present, inverse = np.unique(groups, return_inverse=True)
    return dict(zip(present.tolist(), np.bincount(inverse, np.diff(off)).astype(np.int64).tolist()))


def united(mined: DataFrame, support: int) -> DataFrame:
    """Hashes of the candidates: phrases whose reported counts, with all that the shards may hold
    unreported (less than support / LOWERED), reach the support; and the words to be counted."""
    least = support - support // LOWERED

    def unite(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), U64)
        excess = np.frombuffer(b"".join(group.column("excess").to_pylist()), np.int32)
        order = np.argsort(keys, kind="stable")
        keys, excess = keys[order], excess[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        wanted = (np.add.reduceat(np.maximum(excess, 0), head) >= least) | np.logical_or.reduceat(excess < 0, head)
        return pa.table({"h": pa.array(keys[head[wanted]].view(np.int64))})
    return mined.groupBy("range").applyInArrow(unite, "h long")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits of all hashes; 2**(BITS - 6) words at most reach the driver, whatever the input."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 AS int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(U64)


# ----------------------------------------------------------------------------- exact counts
COUNTED = "lang string, words int, phrase string, n long"


def count_marked(docs: DataFrame, bitmap: np.ndarray, ranges: int, support: int, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """(lang, words, phrase, n): exact counts of the phrases whose bit is set - those of two words and
    more from ``support`` on - and with words = 0 those of all word occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)   # of fixed size

    def run(batches):
        held, have = [], 0
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                held.append((piece.column("lang"), Words(piece, keep_text=True)))
                have += len(held[-1][1].low)
                if have >= count_bytes:
                    yield count(held, shared.value)
                    have = 0
        if held:
            yield count(held, shared.value)

    def count(held: list, bits: np.ndarray) -> pa.RecordBatch:
        lang = pa.concat_arrays([x for x, _ in held])
        w = Words.joint([w for _, w in held])
        held.clear()
        named = lang.dictionary_encode()
        total = np.bincount(np.asarray(named.indices, np.int64)[w.doc], minlength=len(named.dictionary))
        sums = pa.table({"lang": named.dictionary, "words": pa.array(np.zeros(len(total), np.int32)),
                         "phrase": pa.array([""] * len(total), pa.string()), "n": pa.array(total.astype(np.int64))})
        rows: dict[int, list] = {0: [sums]}
        for n in range(1, LONGEST + 1):
            keys = grams(w.hash, n)
            ok = marked(bits, keys)
            if n > 1:
                ok &= runs(w.joined, n - 1)[:len(keys)]
            place = np.flatnonzero(ok)
            keys = keys[place]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            at = place[order[head]]
            made = pa.table({"lang": lang.take(pa.array(w.doc[at])), "words": pa.array(np.full(len(at), n, np.int32)),
                             "phrase": phrase_texts(w, at, n), "n": pa.array(np.diff(head, append=len(keys)).astype(np.int64))})
            for r, a, b in range_slices(keys[head], ranges):
                rows.setdefault(r, []).append(made.slice(a, b - a))
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([packed(t) for t in rows.values()], pa.binary())],
                                          names=["range", "rows"])

    def add_up(group: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(x).read_all() for x in group.column("rows").to_pylist()]
        sums = pa.concat_tables(parts).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")])
        few, n = sums.column("words").to_numpy() < 2, sums.column("n_sum").to_numpy()
        return sums.filter(pa.array(few | (n >= support))).rename_columns(
            {"n_sum": "n"}).select(["lang", "words", "phrase", "n"])
    return docs.mapInArrow(releasing(run), "range int, rows binary").groupBy("range").applyInArrow(add_up, COUNTED)


def packed(tables: list[pa.Table]) -> bytes:
    """Tables of equal columns as one Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, tables[0].schema) as stream:
        for t in tables:
            stream.write_table(t)
    return out.getvalue().to_pybytes()


def phrase_texts(w: Words, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each position, joined by one space."""
    word = at[:, None] + np.arange(n)
    start, size = w.starts[word], (w.ends - w.starts)[word]
    total = size.sum(1) + n - 1
    stop = np.cumsum(total)
    # where each word goes: after the words before it and one space each
    to = (stop - total)[:, None] + np.cumsum(size, axis=1) - size + np.arange(n)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    size, start, to = size.ravel(), start.ravel(), to.ravel()
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inner] = w.low[np.repeat(start, size) + inner]
    ends = np.concatenate([[0], stop]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def frequent_phrases(docs: DataFrame, support: int = 30, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, n): exact counts of every phrase of 2 to 4 words with n >= support, of
    the words in them, and with words = 0 of all word occurrences of a language."""
    spark = docs.sparkSession
    prepare(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"),
                        F.pmod(F.xxhash64(lang), F.lit(GROUPS)).cast("int").alias("grp"))
    sizes = np.zeros(GROUPS, np.int64)
    for group, n in texts.groupBy("grp").agg(F.sum(F.octet_length("text"))).collect():   # GROUPS rows at most
        sizes[group] = n
    # as few tasks as hold a shard each, so that local supports stay high
    shards = texts.coalesce(max(1, -(-int(sizes.sum()) // shard_bytes)))
    pairs = stored(united(mine(shards, sizes, _mine_pairs, support, None, shard_bytes), support), "pairs")
    longer = united(mine(shards, sizes, _mine_longer, support, bitmap_of(pairs), shard_bytes), support)
    bitmap = bitmap_of(pairs.unionByName(longer))
    return stored(count_marked(texts, bitmap, hash_ranges(int(sizes.sum())), support), "phrases")


# ----------------------------------------------------------------------------- collocations
def _words_of(phrase: str = "phrase"):
    return F.split(phrase, " ", -1)


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The best ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    table = frequent_phrases(docs, support, shard_bytes)
    found = table.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), _words_of().alias("w"))
    counts = table.where("words > 0").select("lang", "phrase", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    # phrases that lie in a longer one with at least 80 % of their count
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covers = found.where("words > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(covers, ["lang", "phrase"], "left").where(
        "longer IS NULL OR 100 * cast(longer AS decimal(20, 0)) < 80 * cast(a AS decimal(20, 0))").drop("longer")

    # the lowest-scoring cut into two parts
    cuts = kept.select("lang", "phrase", "words", "a", "w", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"),
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "),
                             "right": F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")}).drop("w")
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), "salt", F.col("n").alias(name))
        cuts = cuts.join(part, ["lang", side, "salt"]).drop(side)
    score = F.expr("cast(2000000 AS decimal(7, 0)) * cast(a AS decimal(20, 0)) "
                   "div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))").cast("long")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    scored = lowest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
                           F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of every part of a language first, so that at most SALTS * top rows of it meet
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = table.where("words = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
