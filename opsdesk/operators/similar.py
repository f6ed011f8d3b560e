"""Similar and duplicate detection (SIM1-SIM3, S5, S9, J13).

SIM1 — every ticket against all *other* tickets.  Scores depend only on the two texts, so
equal texts are collapsed and distinct texts meet in a cosine threshold join: packed blocks with
bounds per dimension stay where they are, slabs of texts are sent to them, and only each text's
best matches and its number of probable duplicates leave a task.

SIM2 — corpus-wide near duplicates by token-set Jaccard ≥ t, exact: prefix filtering
(rarest-first token order; two sets with J ≥ t must share a token within their first
|A| − ⌈t·|A|⌉ + 1 tokens) generates candidates through inverted indexes of slabs of sets; sketches
tell which sets have a partner, and every candidate pair of those is verified with the full sets, in
the same task.  No all-pairs step, no candidate cap.

SIM3 — exact duplicates by sha-256 of the normalised lower-case text.
"""

from __future__ import annotations

import concurrent.futures
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import normalize_ws, round_half_up, tokenize
from opsdesk.operators import vectors as V
from opsdesk.operators.queue import running_number
from opsdesk.session import scratch_path, stored


def ticket_text(subject: str = "subject", description: str = "description") -> Column:
    return F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit("")))


def match_type(cos: Column, cand_status: Column) -> Column:
    return F.when(cos >= LX.DUPLICATE_MIN_SCORE, "probable_duplicate") \
        .when(cand_status.isin("Resolved", "Closed"), "resolved_case").otherwise("similar")


TEXT_GROUP = 4096            # expected distinct texts that are packed together


def _matches(shared, k: int, min_score: float, same: float, pairs: bool = False):
    """mapInArrow body: for every text of the slab its ``k`` best texts of score >= ``min_score``
    among a task's blocks, and how many texts (and tickets) reach ``same``.  A block is visited only
    for texts whose k-th score, or ``same``, it can reach.  With ``pairs``: instead, every pair that
    reaches ``same``, with the tickets of its second text, block by block."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        ids, vec, norm2 = shared.value
        if not len(vec):
            return
        q = vec.astype(np.float64)
        unit = q / np.sqrt(np.maximum(norm2, 1))[:, None]
        pos, neg = np.maximum(unit, 0), np.minimum(unit, 0)
        best = V.Best(len(q), k, 1, valued=True)
        if pairs:
            best.theta[:] = np.inf                # only blocks that can reach ``same`` are visited
        links, tickets = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                high, low = (np.stack([np.frombuffer(x) for x in batch.column(c).to_pylist()]) for c in ("high", "low"))
                bound = pos @ high.T + neg @ low.T
                for b in np.argsort(-bound.mean(0), kind="stable").tolist():
                    reach = np.maximum(min_score, (best.theta - 0.5) / 1000)      # theta is a rounded score
                    need = np.flatnonzero(bound[:, b] >= np.minimum(reach, same) - V.SLACK)
                    if not len(need):
                        continue
                    block = V._Block(batch, b)
                    for a in range(0, len(need), 1024):
                        me = need[a:a + 1024]
                        norm = np.sqrt((norm2[me][:, None] * block.norm2).astype(np.float64))
                        cos = (q[me] @ block.dense.T) / np.where(norm > 0, norm, 1)
                        if pairs:
                            i, j = np.nonzero(cos >= same)
                            if len(i):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(ids[me[i]]), pa.array(block.doc[j]), pa.array(cos[i, j]), pa.array(block.weight[j])],
                                    names=["a", "b", "cosine", "tickets"])
                            continue
                        score = np.where(cos >= min_score, np.floor(cos * 1000 + 0.5), -np.inf)
                        best.add(me, score, block.doc, value=cos)
                        close = cos >= same
                        links[me] += close.sum(1)
                        tickets[me] += close @ block.weight
        if pairs:
            return
        best.cut()
        at, score, doc, cos = best.kept
        some = np.flatnonzero(links)
        nothing = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(ids[at]), pa.array(ids[some])]),
             pa.concat_arrays([pa.array(doc), nothing.cast(pa.int64())]), pa.concat_arrays([pa.array(cos), nothing.cast(pa.float64())]),
             pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(links[some])]),
             pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(tickets[some])])],
            names=["a", "b", "cosine", "links", "tickets"])
    return run


def text_matches(texts: DataFrame, k: int, min_score: float, same: float, slab_bytes: int = V.SLAB_BYTES,
                 pairs: bool = False) -> DataFrame:
    """From distinct texts (place, text, copies): rows (a, b, cosine) of each text's k best texts by
    rounded score, then smaller place - itself among them - and rows (a, links, tickets) with the
    texts and tickets whose cosine reaches ``same``, itself included.  At most k + 1 rows per text
    leave a task, whatever the size of a family of similar texts.  With ``pairs``: rows (a, b, cosine,
    tickets) of all pairs that reach ``same``, both ways and with itself; ``tickets`` are those of b."""
    groups = -(-texts.count() // TEXT_GROUP)
    rows = V.grouped(texts, groups, "place").select(
        F.lit("").alias("commit"), "grp", F.col("place").alias("doc_id"), F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"), F.col("copies").alias("weight"))
    blocks = stored(V.blocks_of(rows), "text-blocks").withColumn("dead", F.lit(None).cast("array<bigint>"))
    context = texts.sparkSession.sparkContext

    def score(slab: DataFrame) -> DataFrame:
        import numpy as np
        t = slab.toArrow().combine_chunks()                      # at most slab_bytes
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.int32).reshape(-1, LX.HASH_DIMS)
        shared = context.broadcast((t.column("qid").to_numpy(), vec, t.column("norm2").to_numpy()))
        return blocks.mapInArrow(_matches(shared, k, min_score, same, pairs), "a long, b long, cosine double, tickets long" if pairs
                                 else "a long, b long, cosine double, links long, tickets long")
    vectors = V.query_vectors(texts, "place", "text")
    return stored(V.per_slab(V.slabs_of(vectors, F.lit(8 * LX.HASH_DIMS), slab_bytes), score), "text-matches")


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("ticket_id").asc()]


def ticket_texts(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickets (ticket_id, created_at, status, text, th) and their distinct texts (th, place, group_id,
    copies, text): numbered by their newest ticket, ``group_id`` is the smallest ticket of a text."""
    t = stored(tickets.select(F.col("id").alias("ticket_id"), "created_at", "status", ticket_text().alias("text"))
               .withColumn("th", F.sha2(F.col("text"), 256)), "tickets")
    groups = t.groupBy("th").agg(F.min("ticket_id").alias("group_id"), F.count(F.lit(1)).alias("copies"),
                                 F.max("created_at").alias("created_at"))
    last = t.join(groups.select("th", "created_at"), ["th", "created_at"]).groupBy("th").agg(F.min("ticket_id").alias("ticket_id"))
    groups = groups.join(t.select("th", "text").distinct(), "th")
    numbered = running_number(groups.join(last, "th").withColumn("all", F.lit(0)), "all", newest_first(), "place")
    return t, stored(numbered.select("th", "place", "group_id", "copies", "text"), "texts")


def duplicate_pairs(tickets: DataFrame, same: float = LX.DUPLICATE_MIN_SCORE, slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
    """SIM1: every probable duplicate as a pair of texts (group_id, matched_group_id, score, tickets,
    matched_tickets), each named by its smallest ticket, the smaller first; a text of several tickets is
    paired with itself.  Copies are counted, not expanded."""
    texts = ticket_texts(tickets)[1]
    found = text_matches(texts.select("place", "text", "copies"), 1, same, same, slab_bytes, pairs=True)
    a = texts.select(F.col("place").alias("a"), "group_id", F.col("copies").alias("tickets"))
    b = texts.select(F.col("place").alias("b"), F.col("group_id").alias("matched_group_id"))
    return found.withColumnRenamed("tickets", "matched_tickets").join(a, "a").join(b, "b") \
        .where("group_id < matched_group_id OR (group_id = matched_group_id AND tickets > 1)").select(
            "group_id", "matched_group_id", round_half_up(F.col("cosine"), 3).alias("score"), "tickets", "matched_tickets")


def similar_tickets(tickets: DataFrame, top: int = LX.SIMILAR_TOP, min_score: float = LX.SIMILAR_MIN_SCORE,
                    slab_bytes: int = V.SLAB_BYTES) -> dict:
    """SIM1 + S5 over *all* other tickets (no candidate cap).

    Equal texts are one text; texts are numbered by their newest ticket, so that a smaller number
    wins ties.  A cosine threshold join with bounds (``text_matches``) gives the best ``top`` + 1
    texts of every text; a ticket's best matches lie among the ``top`` + 1 newest tickets of those.

    * ``similar``: top 8 per ticket by rounded score, newest first, then id: the ordered list of its text
      without the ticket itself, so no row per ticket and match is shuffled;
    * ``similar_counts``: how many those are, for every ticket that has any;
    * ``duplicates``: one row per text with probable duplicates: group_id (its smallest ticket),
      tickets, duplicate_groups (other texts), duplicate_tickets (tickets with those texts) and the
      closest of them (matched_group_id, score);
    * ``duplicate_counts``: the number of probable duplicates of every ticket that has any."""
    same = LX.DUPLICATE_MIN_SCORE
    t, texts = ticket_texts(tickets)
    pairs = text_matches(texts.select("place", "text", "copies"), top + 1, min_score, same, slab_bytes)
    t = t.drop("text")
    newest = t.withColumn("nr", F.row_number().over(Window.partitionBy("th").orderBy(*newest_first()))).where(F.col("nr") <= top + 1) \
        .join(texts.select("th", "place"), "th").drop("th")
    cand = pairs.where("b IS NOT NULL").join(newest.withColumnRenamed("place", "b"), "b").select(
        F.col("a").alias("place"), F.col("ticket_id").alias("matched_ticket_id"), F.col("created_at").alias("cand_created"),
        round_half_up(F.col("cosine"), 3).alias("score"), match_type(F.col("cosine"), F.col("status")).alias("match_type"))
    best_first = [F.col("score").desc(), F.col("cand_created").desc(), F.col("matched_ticket_id").asc()]
    per_text = cand.withColumn("pr", F.row_number().over(Window.partitionBy("place").orderBy(*best_first))) \
        .where(F.col("pr") <= top + 1).drop("pr")
    numbered = per_text.withColumn("pr", F.row_number().over(Window.partitionBy("place").orderBy(*best_first)))
    lists = numbered.groupBy("place").agg(F.sort_array(F.collect_list(            # at most top + 1 a text
        F.struct("pr", "matched_ticket_id", "score", "match_type"))).alias("matches")).join(texts.select("th", "place"), "place").drop("place")
    ids = t.select("ticket_id", "th").where("ticket_id IS NOT NULL")
    # ids that several rows share are ranked over all of those; any other ticket has its text's list without itself
    repeated = stored(ids.groupBy("ticket_id").count().where("count > 1").select("ticket_id"), "repeated-ids")
    shared = not repeated.isEmpty()
    others = F.slice(F.filter("matches", lambda m: m["matched_ticket_id"] != F.col("ticket_id")), 1, top)
    own = (ids.join(repeated, "ticket_id", "left_anti") if shared else ids).join(lists, "th").select("ticket_id", others.alias("m"))
    similar = own.select("ticket_id", F.posexplode("m").alias("at", "m")).select(
        "ticket_id", "m.matched_ticket_id", "m.score", "m.match_type", (F.col("at") + 1).alias("rank"))
    similar_counts = own.select("ticket_id", F.size("m").cast("bigint").alias("similar_count")).where("similar_count > 0")
    if shared:
        places = texts.select("th", "place")
        more = ids.join(repeated, "ticket_id", "left_semi").join(places, "th").drop("th").join(per_text, "place") \
            .where("ticket_id <> matched_ticket_id") \
            .withColumn("rank", F.row_number().over(Window.partitionBy("ticket_id").orderBy(*best_first))) \
            .where(F.col("rank") <= top).select("ticket_id", "matched_ticket_id", "score", "match_type", "rank")
        similar = similar.unionByName(more)
        similar_counts = similar_counts.unionByName(more.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("similar_count")))
    sums = pairs.where("b IS NULL").groupBy(F.col("a").alias("place")).agg(
        F.sum("links").alias("links"), F.sum("tickets").alias("reached")).where("reached > 1")
    closest = pairs.where(f"b <> a AND cosine >= {same}").groupBy(F.col("a").alias("place")).agg(
        F.min(F.struct((-round_half_up(F.col("cosine"), 3)).alias("low"), F.col("b").alias("b"))).alias("m"))
    other = texts.select(F.col("place").alias("b"), F.col("group_id").alias("matched_group_id"))
    duplicates = texts.join(sums, "place").join(closest, "place", "left").withColumn("b", F.col("m.b")) \
        .join(other, "b", "left").select(
            "group_id", F.col("copies").alias("tickets"), (F.col("links") - 1).alias("duplicate_groups"),
            (F.col("reached") - F.col("copies")).alias("duplicate_tickets"), "matched_group_id", (-F.col("m.low")).alias("score"))
    reached = sums.join(texts.select("th", "place"), "place").select("th", "reached")
    duplicate_counts = t.select("ticket_id", "th").join(reached, "th").select(
        "ticket_id", (F.col("reached") - 1).alias("duplicate_count"))
    return {"similar": similar, "similar_counts": similar_counts, "duplicates": duplicates, "duplicate_counts": duplicate_counts}


# ----------------------------------------------------------------------------- SIM2
HEAVY = 1 << 20              # matches of prefix tokens that a task holds at once
ORDERED = 1 << 20            # most frequent tokens whose order is sent to the tasks; others come before them
SET_SLAB = 32 << 20          # bytes of the sets that are sent to the tasks at once
PIECES = 8                   # files of a slab
FEW_KEYS = 1 << 20           # keys that are sent to the tasks
CODED = {"parquet.dictionary.page.size": str(32 << 20)}      # tokens come often: written as numbers of a dictionary
EPS = 1e-9


def _list(column) -> tuple:
    """(values, offsets) of a list column."""
    import numpy as np
    a = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    first = a.offsets.to_numpy().astype(np.int64)
    return a.flatten().to_numpy(zero_copy_only=False), first - first[0]


def _places(size):
    """0, 1, ... within each of consecutive runs of the given sizes."""
    import numpy as np
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _bits(n):
    """Bits of the sketch of a set of ``n`` tokens: a power of two, at least n and 256."""
    import numpy as np
    return np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(n, 1))), 8, 16).astype(np.int64)


def _sketches(toks, first):
    """Parity of the tokens per hash bucket, ``_bits`` buckets a set, as a binary column: two sets differ
    in at least as many tokens as their sketches in bits.  The halves of a sketch, one XOR the other, are
    the sketch of half the bits."""
    import numpy as np
    import pyarrow as pa
    bits = _bits(np.diff(first))
    end = np.cumsum(bits)
    parts, lo = [], 0
    while lo < len(bits):
        begin = end[lo] - bits[lo]
        hi = max(lo + 1, int(np.searchsorted(end, begin + (1 << 22), side="right")))
        size = np.diff(first[lo:hi + 1])
        t = toks[first[lo]:first[hi]]
        at = np.repeat(end[lo:hi] - bits[lo:hi] - begin, size) + (t & np.repeat(bits[lo:hi] - 1, size))
        parts.append(np.packbits((np.bincount(at, minlength=int(end[hi - 1] - begin)) & 1).astype(np.uint8)))
        lo = hi
    offsets = np.concatenate([[0], end // 8]).astype(np.int64)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def _token_order(sets: DataFrame, ordered: int):
    """Broadcast (token, rank by the number of its sets) of the ``ordered`` most frequent tokens, by token."""
    import numpy as np
    df = stored(sets.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
                .where("df > 1"), "frequencies")
    levels = df.groupBy("df").count().orderBy(F.col("df").desc()).toArrow()        # one row per frequency
    fits = np.flatnonzero(np.cumsum(levels.column("count").to_numpy()) <= ordered)
    least = levels.column("df")[int(fits[-1])].as_py() if len(fits) else None
    frequent = df.where(F.col("df") >= F.lit(least).cast("long")).toArrow()        # at most ``ordered`` rows
    known, count = frequent.column("token").to_numpy(), frequent.column("df").to_numpy()
    rank = np.empty(len(known), np.int32)
    rank[np.lexsort((known, count))] = np.arange(len(known), dtype=np.int32)
    by = np.argsort(known)
    return sets.sparkSession.sparkContext.broadcast((known[by], rank[by]))


def _buckets(known) -> tuple:
    """Bits and, for each value of that many leading bits, the first of the ascending hashes ``known`` that has it."""
    import numpy as np
    bits = max(1, len(known).bit_length())
    return bits, np.searchsorted(known >> (64 - bits), np.arange(-(1 << bits - 1), (1 << bits - 1))).astype(np.int32)


def _found(known, buckets, toks):
    """Where the hashes ``toks`` are, or would be, in ``known``."""
    import numpy as np
    bits, start = buckets
    at = start[(toks >> (64 - bits)) + (1 << bits - 1)].astype(np.int64)
    todo = np.arange(len(toks))
    while len(todo):                           # hashes are dealt evenly: a few a bucket
        here = at[todo]
        todo = todo[(here < len(known)) & (known[np.minimum(here, len(known) - 1)] < toks[todo])]
        at[todo] += 1
    return at


def _signatures(order, bounds, t: float, names: list[str]):
    """mapInArrow body: of each set its columns ``names``, its sketch, its piece (by ``bounds`` of places)
    and its first |A| − ⌈t·|A|⌉ + 1 tokens, rarest first: those that meet larger sets in ``prefix``, the
    others in ``rest``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        known, rank = order.value
        buckets = _buckets(known)
        for batch in batches:
            toks, first = _list(batch.column("toks"))
            n = np.diff(first)
            level = np.zeros(len(toks), np.int64)
            if len(known):
                at = np.minimum(_found(known, buckets, toks), len(known) - 1)
                level = np.where(known[at] == toks, rank[at] + 1, 0).astype(np.int64)
            # one sort of (set, level, place): toks ascend in a set
            wide, high = int(n.max(initial=0)).bit_length(), len(known).bit_length()
            by = np.sort((((np.repeat(np.arange(len(n)), n) << high) | level) << wide) | _places(n)) & ((1 << wide) - 1)
            take = (n - np.ceil(n * t - EPS) + 1).astype(np.int64)
            meet = np.minimum(take, (n - np.ceil(2 * t / (1 + t) * n - EPS) + 1).astype(np.int64))
            lists = []
            for low, size in ((0, meet), (meet, take - meet)):
                at = np.repeat(first[:-1] + low, size) + _places(size)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                      pa.array(toks[np.repeat(first[:-1], size) + by[at]])))
            piece = np.searchsorted(bounds, batch.column("place").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [_sketches(toks, first), *lists, pa.array(piece.astype(np.int32))],
                                             names=[*names, "sketch", "prefix", "rest", "piece"])
    return run


def _folded(sketches, bits, level: int):
    """Sketches of ``bits`` bits each (a multiple of ``level``) as rows of ``level`` bits."""
    import numpy as np
    out, at = [], 0
    words = np.frombuffer(sketches, np.uint64)
    for width in np.unique(bits).tolist():
        k = int((bits == width).sum())
        some = words[at:at + k * width // 64].reshape(k, width // level, level // 64)
        out.append(np.bitwise_xor.reduce(some, 1))
        at += k * width // 64
    return np.concatenate(out)


def _numbered(values) -> tuple:
    """(distinct values, ascending; the number of each value)."""
    import numpy as np
    import pyarrow as pa
    coded = pa.array(values).dictionary_encode()                   # faster than a sort of all
    words = coded.dictionary.to_numpy()
    by = np.argsort(words)
    number = np.empty(len(words), np.int32)
    number[by] = np.arange(len(words), dtype=np.int32)
    return words[by], number[coded.indices.to_numpy()]


def _inverted(slab, t: float) -> dict:
    """A slab of sets as arrays, by (place, set_key): its sets, their sketches by number of bits, and the
    inverted index of their prefix tokens: ``token`` and, for each, the sets that have it, ascending."""
    import numpy as np
    import pyarrow as pa
    slab = slab.take(pa.array(np.lexsort((slab.column("set_key").to_numpy(), slab.column("place").to_numpy()))))
    place = slab.column("place").to_numpy()
    n = place >> 32
    token, start = zip(*(_list(slab.column(c)) for c in ("prefix", "rest")))
    token, entry = _numbered(np.concatenate(token))                # (memory of the driver: one large array less each step)
    first = np.append(0, np.cumsum(np.bincount(entry, minlength=len(token))))
    entry = entry * np.int64(len(n))
    entry += np.concatenate([np.repeat(np.arange(len(n), dtype=np.int32), np.diff(x)) for x in start])
    entry.sort()
    bits, sketch, levels = _bits(n), slab.column("sketch").to_pylist(), {}
    far = 1 << max(0, math.ceil(math.log2(1 / t) - EPS))
    level = 256
    while level <= 1 << 16:                    # sets of ``level`` bits meet sets of up to far times as many
        lo, hi = np.searchsorted(bits, level), np.searchsorted(bits, far * level, side="right")
        if lo < hi:
            levels[level] = int(lo), _folded(b"".join(sketch[lo:hi]), bits[lo:hi], level)
        level *= 2
    out = {"place": place, "key": slab.column("set_key").to_numpy(), "n": n, "token": token,
           "start": first, "entry": entry, "levels": levels}
    if "toks" in slab.column_names:
        toks, first = _list(slab.column("toks"))
        words, ids = _numbered(toks)
        out |= {"d": slab.column("d").combine_chunks(), "copies": slab.column("copies").to_numpy(), "first": first,
                "words": words, "toks": ids}
    return out


def _differ(x, y):
    """Bits in which the rows of two arrays of words differ."""
    import numpy as np
    four = np.bitwise_count(x ^ y).view(np.uint32)                 # four counts of at most 64 each
    two = (four & np.uint32(0x00FF00FF)) + ((four >> np.uint32(8)) & np.uint32(0x00FF00FF))
    one = (two & np.uint32(0xFFFF)) + (two >> np.uint32(16))
    return one[:, 0] if one.shape[1] == 1 else one.sum(1, dtype=np.int64)


def _candidates(slab: dict, batch, t: float, heavy: int, together: bool, skip=None):
    """Pairs (a, b) of a slab's sets with a batch's sets that come before them in (place, set_key) order, so
    are not larger: those that share a prefix token, as the lengths and the token's place in the smaller set
    allow, and whose sketches are near enough.  A pair comes once if ``together``, else once per shared token;
    ``skip`` is true for pairs that need not be compared."""
    import numpy as np
    place, key, n, token, first, entry = (slab[c] for c in ("place", "key", "n", "token", "start", "entry"))
    b_place, b_key = batch.column("place").to_numpy(), batch.column("set_key").to_numpy()
    m = b_place >> 32
    mine, start = _list(batch.column("prefix"))
    # places j (from 0) at which a shared token leaves enough for the slab's smallest set that is not smaller
    reach = np.floor(m - t / (1 + t) * (m + np.maximum(m, n[0])) + 1e-6).astype(np.int64) + 1
    size = np.clip(reach, 0, np.diff(start))
    row, j = np.repeat(np.arange(len(m)), size), _places(size)
    mine = mine[np.repeat(start[:-1], size) + j]
    by = np.argsort(mine)                                          # ordered ones are found faster
    mine = mine[by]
    where = np.minimum(np.searchsorted(token, mine), len(token) - 1)
    some = np.flatnonzero(token[where] == mine)
    where, row, j = where[some], row[by[some]], j[by[some]]
    after = np.searchsorted(place, b_place)                        # the first set of the slab that comes after
    while True:
        at = np.minimum(after, len(place) - 1)
        same = (after < len(place)) & (place[at] == b_place) & (key[at] <= b_key)
        if not same.any():
            break
        after += same
    most = np.minimum(m[row] / t, (1 + t) / t * (m[row] - j) - m[row]) + 1e-6          # tokens of the other set
    before = np.searchsorted(n, np.floor(most).astype(np.int64), side="right")
    lo, hi = first[where], first[where + 1]
    for edge, at, outside in ((lo, after[row], after[row] > 0), (hi, before, before < len(n))):
        cut = np.flatnonzero(outside)
        edge[cut] = np.searchsorted(entry, where[cut] * len(n) + at[cut])
    some = np.flatnonzero(hi > lo)
    if together:
        some = some[np.argsort(row[some], kind="stable")]
    bits = _bits(m)
    raw = batch.column("sketch").cast("binary")
    raw = np.frombuffer(raw.buffers()[2], np.uint8), np.frombuffer(raw.buffers()[1], np.int32, len(m) + 1, raw.offset * 4)
    for level in np.unique(bits[row[some]]).tolist():
        ours, base = np.flatnonzero(bits == level), slab["levels"][level][0]
        nr = np.empty(len(m), np.int64)
        nr[ours] = np.arange(len(ours))
        own = raw[0][raw[1][ours][:, None] + np.arange(level // 8)].view(np.uint64)
        sketch = slab["levels"][level][1]
        use = some[bits[row[some]] == level]
        met = hi[use] - lo[use]
        total = np.cumsum(met)
        if together:                           # the matches of a set stay in one part: at most the slab's index
            edge = np.append(np.flatnonzero(np.diff(row[use], prepend=-1)), len(use))
        else:
            edge = np.arange(len(use) + 1)
        ends = total[edge[1:] - 1]
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + heavy, side="right")))
            part = use[edge[at]:edge[end]]
            at = end
            c = hi[part] - lo[part]
            a = entry[np.repeat(lo[part], c) + _places(c)] - np.repeat(where[part] * len(n), c)
            b = np.repeat(row[part], c)
            if together:
                pair = np.sort(b * len(n) + a)
                b, a = np.divmod(pair[np.diff(pair, prepend=-1) > 0], len(n))
            step = max(1, (1 << 21) // level)
            for s in range(0, len(a), step):
                x, y = a[s:s + step], b[s:s + step]
                if skip is not None:
                    new = ~skip(x, y)
                    x, y = x[new], y[new]
                both = n[x] + m[y]
                near = _differ(sketch[x - base], own[nr[y]]) <= both - 2 * np.ceil(t / (1 + t) * both - EPS)
                if near.any():
                    yield x[near], y[near]


def _with_partner(shared, t: float, heavy: int):
    """mapInArrow body: the keys of the slab's and the task's sets that are in any pair of ``_candidates``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        slab = shared.value
        seen = np.zeros(len(slab["n"]), bool)
        for batch in filter(len, batches):
            mine = np.zeros(batch.num_rows, bool)
            for a, b in _candidates(slab, batch, t, heavy, False, lambda x, y: seen[x] & mine[y]):  # noqa: B023
                seen[a] = mine[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("set_key").to_numpy()[mine])], names=["set_key"])
        yield pa.RecordBatch.from_arrays([pa.array(slab["key"][seen])], names=["set_key"])
    return run


def _near_pairs(shared, t: float, heavy: int):
    """mapInArrow body: the pairs of ``_candidates`` whose full sets reach ``t``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        slab = shared.value
        n, first, words, toks = (slab[c] for c in ("n", "first", "words", "toks"))
        flag = np.zeros(len(words), bool)
        for batch in filter(len, batches):
            b_toks, b_first = _list(batch.column("toks"))
            m = np.diff(b_first)
            for a, b in _candidates(slab, batch, t, heavy, True):
                common = np.zeros(len(a), np.int64)
                cut = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    full = b_toks[b_first[b[x]]:b_first[b[x] + 1]]
                    at = np.minimum(np.searchsorted(words, full), len(words) - 1)
                    at = at[words[at] == full]
                    flag[at] = True
                    others = n[a[x:y]]
                    same = flag[toks[np.repeat(first[a[x:y]], others) + _places(others)]]
                    common[x:y] = np.add.reduceat(same, np.cumsum(others) - others, dtype=np.int64)
                    flag[at] = False
                union = n[a] + m[b] - common
                near = common / np.maximum(union, 1) >= t
                a, b = a[near], b[near]
                yield pa.RecordBatch.from_arrays(
                    [slab["d"].take(pa.array(a)), batch.column("d").take(pa.array(b)), pa.array(common[near]), pa.array(union[near]),
                     pa.array(slab["copies"][a]), batch.column("copies").take(pa.array(b))],
                    names=["x", "y", "inter", "union_size", "copies_x", "copies_y"])
    return run


def _bounds(sets: DataFrame, volume, piece_bytes: int):
    """Places that cut the sets, by size and those of one size by a part of their hash, into pieces of about
    ``piece_bytes``; ``volume`` has the bytes of a set of n tokens."""
    import numpy as np
    sizes = sets.groupBy(F.shiftright("place", 32).alias("n")).count().orderBy("n").toArrow()     # one row per size
    n = sizes.column("n").to_numpy().astype(np.int64)
    each = (sizes.column("count").to_numpy() * volume(n)).astype(np.int64)
    end = np.cumsum(each)
    cut = np.arange(piece_bytes, int(each.sum()), piece_bytes)
    i = np.searchsorted(end, cut, side="right")
    share = (cut - (end[i] - each[i])) / each[i]
    return np.unique((n[i] << 32) + (share * (1 << 32)).astype(np.int64))


def _slab_by_slab(sets: DataFrame, order, t: float, names: list[str], volume, slab_bytes: int, body, columns: str, name: str) -> DataFrame:
    """The sets' signatures are written by place, in pieces.  Slab by slab of them, with its inverted index, is
    sent to the pieces that hold the sets of its range of sizes, where ``body`` runs; the next slab is read
    meanwhile.  What ``body`` gives is stored."""
    spark = sets.sparkSession
    bounds = _bounds(sets, volume, max(1, slab_bytes // PIECES))
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sketch binary, prefix array<long>, rest array<long>, piece int"
    path, to = scratch_path(spark, f"{name}-by-place-{uuid.uuid4().hex}"), scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    sets.mapInArrow(_signatures(order, bounds, t, names), schema).repartition(len(bounds) + 1, "piece") \
        .sortWithinPartitions("piece", "place").write.options(**CODED).partitionBy("piece").parquet(path)
    by_place = spark.read.schema(schema).parquet(path)

    def index(low: int):
        slab = by_place.where(F.col("piece").between(low, low + PIECES - 1)).drop("piece").toArrow()      # about slab_bytes
        if not slab.num_rows:
            return None
        slab = _inverted(slab, t)
        return int(slab["place"][0]), spark.sparkContext.broadcast(slab)

    with concurrent.futures.ThreadPoolExecutor(1) as ahead:
        slabs = range(0, len(bounds) + 1, PIECES)
        following, some = ahead.submit(index, 0), False
        for low in slabs:
            found = following.result()
            if low + PIECES <= len(bounds):
                following = ahead.submit(index, low + PIECES)
            if found is None:
                continue
            shortest = math.ceil((found[0] >> 32) * t - EPS) << 32
            least = int(bounds.searchsorted(shortest, side="right"))
            by_place.where(F.col("piece").between(least, low + PIECES - 1) & (F.col("place") >= shortest)).drop("rest") \
                .mapInArrow(body(found[1]), columns).write.mode("append").parquet(to)
            found[1].destroy()
            some = True
    return spark.read.schema(columns).parquet(to) if some else spark.createDataFrame([], columns)


def near_duplicates(docs: DataFrame, threshold: float = LX.DUPLICATE_MIN_SCORE, key: str = "doc_id",
                    text: str = "text", heavy: int = HEAVY, slab_bytes: int = SET_SLAB, ordered: int = ORDERED) -> DataFrame:
    """SIM2: near-duplicate pairs by token-set Jaccard ≥ ``threshold`` — exact, and safe when
    a large share of the corpus consists of copies.

    0. documents with the *same* token set are collapsed first (group by a hash of the sorted
       set; representative = lowest id, ``copies`` = group size) — a group of copies never
       produces pairs among itself;
    1. distinct tokens ordered globally by (number of sets, token); the ``ordered`` most frequent
       ones by their frequency, those rarer than all of these first, by token alone;
    2. prefix filter: only the first |A| − ⌈t·|A|⌉ + 1 tokens of each set are indexed;
    3. length filter: t·|A| ≤ |B| ≤ |A| / t;
    4. positional filter: with j the place of a shared token in the smaller set B,
       overlap ≤ 1 + |B| − j must reach ⌈t / (1 + t) · (|A| + |B|)⌉ for the first, which bounds |A|;
       sketch filter: parity sketches may differ in no more bits than the sets may in tokens;
    5. sets with any partner so far go through the same again and are verified with the full sets.
    Tokens are 64-bit hashes from the start, so no strings are shuffled.  A slab (``slab_bytes``) of prefixes
    and sketches with its inverted index is broadcast and meets those of its range of sizes, so candidates
    never leave a task; only sets with a partner are read in full again, slab by slab in the same way:
    disk grows with the documents and the result, not with the pairs that share a token.
    Output: one row per pair of distinct sets (their representatives) with both copy counts (as many
    rows as the representatives' ids have, where ids repeat) — lossless: every near-duplicate document pair is either inside one copy group (Jaccard 1)
    or maps to exactly one row.  Every filter is a necessary condition (= brute force)."""
    t = float(threshold)
    # (rows without words are dropped late: a filter on ``toks`` would tokenise twice)
    per_doc = docs.select(F.col(key).alias("doc"), F.sort_array(F.array_distinct(
        F.transform(tokenize(F.col(text)), lambda x: F.xxhash64(x)))).alias("toks"))
    # the sets by size, those of one size by a part of their hash
    place = F.shiftleft(F.size("toks").cast("long"), 32) + F.col("set_key").bitwiseAND(F.lit((1 << 32) - 1))
    sets = stored(per_doc.withColumn("set_key", F.xxhash64("toks")).groupBy("set_key").agg(
        F.min("doc").alias("d"), F.count(F.lit(1)).alias("copies"), F.first("toks").alias("toks"))
        .where((F.size("toks") > 0) & F.col("d").isNotNull()).withColumn("place", place), "sets", CODED)

    order = _token_order(sets, ordered)

    def signature(n):
        return 8 * (1 - t) * n + _bits(n) // 8 + 64

    partners = _slab_by_slab(sets, order, t, ["place", "set_key"], signature, slab_bytes,
                             lambda slab: _with_partner(slab, t, heavy), "set_key long", "with-partner")
    partners = stored(partners.distinct(), "partners")
    if partners.count() <= FEW_KEYS:
        partners = F.broadcast(partners)
    some = stored(sets.join(partners, "set_key", "left_semi"), "sets-with-partner", CODED)
    kind = sets.schema["d"].dataType.simpleString()
    found = _slab_by_slab(some, order, t, ["place", "set_key", "d", "copies", "toks"], lambda n: signature(n) + 8 * n, slab_bytes,
                          lambda slab: _near_pairs(slab, t, heavy),
                          f"x {kind}, y {kind}, inter long, union_size long, copies_x long, copies_y long", "near-pairs")
    order.destroy()
    first = F.col("x") < F.col("y")
    pairs = found.where("x <> y").select(
        F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "inter", "union_size",
        (F.col("inter") / F.col("union_size")).alias("jaccard"),
        F.when(first, F.col("copies_x")).otherwise(F.col("copies_y")).alias("copies_a"),
        F.when(first, F.col("copies_y")).otherwise(F.col("copies_x")).alias("copies_b"))
    # a representative whose id stands in several rows has its pairs once for each
    if docs.groupBy(key).count().where("count > 1").isEmpty():        # (without reading the texts)
        return pairs
    repeated = stored(docs.where(F.col(text).rlike(LX.TOKEN_PATTERN)).groupBy(F.col(key).alias("doc"))
                      .agg(F.count(F.lit(1)).alias("times")).where("times > 1 AND doc IS NOT NULL"), "repeated-ids")
    if repeated.isEmpty():
        return pairs
    for doc in ("doc_a", "doc_b"):
        times = repeated.select(F.col("doc").alias(doc), F.col("times").alias(f"times_{doc}"))
        pairs = pairs.join(times, doc, "left")
    every = F.sequence(F.lit(1), (F.coalesce("times_doc_a", F.lit(1)) * F.coalesce("times_doc_b", F.lit(1))).cast("int"))
    return pairs.withColumn("time", F.explode(every)).select(
        "doc_a", "doc_b", "inter", "union_size", "jaccard", "copies_a", "copies_b")


# ----------------------------------------------------------------------------- SIM3
def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SIM3: documents whose normalised lower-case text occurs more than once, with the
    group's canonical (lowest) id and size.  Group stats come from an aggregate joined
    back by hash — no group is ever collected into one row."""
    # hashed once: both sides of the join below read the written keys
    h = stored(docs.select(F.col(key).alias("doc_id"), F.sha2(normalize_ws(F.lower(F.col(text))), 256).alias("dup_key")),
               "text-keys")
    groups = h.groupBy("dup_key").agg(F.min("doc_id").alias("canonical_doc_id"),
                                      F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    return h.join(groups, "dup_key", "inner").select(
        "doc_id", "dup_key", "canonical_doc_id", "group_size",
        (F.col("doc_id") != F.col("canonical_doc_id")).alias("is_copy"))
