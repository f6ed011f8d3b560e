"""Best-fit packing by patterns: non-negative least squares on the histogram of lengths.

Documents are encoded once; a document longer than a sequence is cut into full pieces and a rest.
What is planned is only the histogram of piece lengths (one count per length up to the capacity):

1. **patterns**: all ways to fill a sequence exactly with one, two or three pieces of lengths that
   occur (about capacity**2 / 12);
2. **fit**: repeat counts x >= 0 that minimise the weighted squared difference between the pieces
   the patterns use and the histogram (multiplicative updates, so x never leaves x >= 0; long
   pieces weigh more, as short ones are easy to place later);
3. **round**: running sums of x are rounded along the longest piece, so neighbours make up for each
   other, and no pattern takes more pieces than there are.  Of x and some shares of it (``SHARES``),
   the one whose whole plan needs the fewest sequences counts: where lengths are many and pieces few,
   exact fillings can use up what the residual needs;
4. **residual**: what is left, and every piece shorter than capacity / ``RESERVE``, goes best-fit
   decreasing, a whole group of equal pieces into a whole group of equal sequences at a time.

The plan depends on the capacity alone in size and cost, never on the number of documents, and is
made once on the driver.  Pieces then only need their number among the pieces of equal length:
counted inside each task while encoding, continued over tasks by a running sum of the tasks' counts.
A length that holds a third of all pieces is spread like any other; nothing is grouped by length.

Cases: null text is an empty text (its only token is ``eos``); repeated rows are documents of
their own; an empty table gives an empty result; a null doc_id stays null; extra columns are
ignored.  A text is encoded as one unit, whatever its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.llm.common import id_text, prepare, releasing, stored
from opsdesk.llm.packing import PIECE_SCHEMA, piece_batches

ROUNDS = 100        # multiplicative updates of the fit
SHARES = (1.0, 0.75, 0.5, 0.25)
RESERVE = 16        # pieces shorter than capacity / RESERVE are kept for the residual

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ----------------------------------------------------------------------------- plan
def enumerate_patterns(present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none), longest first, that sum to the capacity; ``present`` flags
    the lengths 0 .. capacity that may be used."""
    capacity = len(present) - 1
    rows = [np.array([[capacity, 0, 0]])[present[[capacity]]]]
    short = np.arange(1, capacity // 2 + 1)
    short = short[present[short] & present[capacity - short]]
    rows.append(np.stack([capacity - short, short, 0 * short], 1))
    for low in range(1, capacity // 3 + 1):
        if present[low]:
            mid = np.arange(low, (capacity - low) // 2 + 1)
            mid = mid[present[mid] & present[capacity - low - mid]]
            rows.append(np.stack([capacity - low - mid, mid, np.full(len(mid), low)], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 for which the patterns' pieces are closest to ``counts``, in weighted least squares."""
    capacity = len(counts) - 1
    weight = (np.arange(capacity + 1) / capacity) ** 2
    wanted = (weight * counts)[patterns].sum(1)
    x = np.full(len(patterns), counts.sum() / (3 * max(1, len(patterns))))
    for _ in range(rounds):
        used = np.bincount(patterns.ravel(), np.repeat(x, 3), capacity + 1)
        x *= wanted / np.maximum((weight * used)[patterns].sum(1), 1e-300)
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole repeat counts, as [(pieces, repeats)]; takes the pieces out of ``left``."""
    order = np.lexsort((patterns[:, 1], patterns[:, 0]))
    repeats = np.diff(np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64), prepend=0)
    out = []
    for row, n in zip(patterns[order[repeats > 0]].tolist(), repeats[repeats > 0].tolist()):
        parts = tuple((size, row.count(size)) for size in sorted({s for s in row if s}, reverse=True))
        n = min([n] + [int(left[size]) // times for size, times in parts])
        if n > 0:
            for size, times in parts:
                left[size] -= n * times
            out.append((parts, n))
    return out


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[tuple, int]]:
    """[(pieces, repeats)] of best-fit decreasing over a histogram.  Sequences of equal content
    are one group, so the steps follow the number of different lengths, not of pieces."""
    capacity = len(counts) - 1
    room: dict[int, list] = {}         # free tokens -> [[pieces, repeats], ...]
    keys: list[int] = []
    done = []

    def put(parts: tuple, n: int, free: int) -> None:
        if n and not free:
            done.append((parts, n))
        elif n:
            if free not in room:
                room[free] = []
                insort(keys, free)
            room[free].append([parts, n])

    for size in range(capacity, 0, -1):
        c = int(counts[size])
        while c:
            at = bisect_left(keys, size)
            free = keys[at] if at < len(keys) else capacity
            group = room[free][-1] if at < len(keys) else [(), c]
            parts, n = group
            times = min(free // size, c)
            whole = min(n, c // times)
            group[1] -= whole
            if at < len(keys) and not group[1]:
                room[free].pop()
                if not room[free]:
                    del room[free]
                    keys.pop(at)
            put(parts + ((size, times),), whole, free - times * size)
            c -= whole * times
    for free in keys:
        done += [(parts, n) for parts, n in room[free]]
    return done


class Plan:
    """Where the pieces of every length go: slots[length][number] -> (sequence, offset)."""

    def __init__(self, counts: np.ndarray, rounds: int = ROUNDS):
        capacity = len(counts) - 1
        fitted = counts.copy()
        fitted[:capacity // RESERVE] = 0
        patterns = enumerate_patterns(fitted > 0)
        x = fit_repeats(patterns, fitted, rounds)
        least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        self.sequences = None
        for share in SHARES:
            left = counts.copy()
            made = round_repeats(patterns, x * share, left)
            rest = best_fit_decreasing(left)
            n = sum(k for _, k in made + rest)
            if self.sequences is None or n < self.sequences:
                groups, self.sequences, self.fitted = made + rest, n, sum(k for _, k in made)
            if self.sequences == least:
                break
        rows, base = [], 0
        for parts, n in groups:
            offset = 0
            for size, times in parts:
                for _ in range(times):
                    rows.append((size, n, base, offset))
                    offset += size
            base += n
        rows = np.array(rows, np.int64).reshape(-1, 4)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.first = np.cumsum(counts) - counts                 # number of a length's first piece
        self.start = np.cumsum(rows[:, 1]) - rows[:, 1]          # number of a slot's first piece
        self.base, self.offset = rows[:, 2].copy(), rows[:, 3].copy()

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these numbers among those of equal length."""
        at = self.first[length] + number
        slot = np.searchsorted(self.start, at, side="right") - 1
        return self.base[slot] + at - self.start[slot], self.offset[slot]


# ----------------------------------------------------------------------------- pieces
def numbered_pieces(docs: DataFrame, spec: bytes, capacity: int, eos: int) -> DataFrame:
    """Pieces with ``part`` (the task that cut them) and ``nth`` among the task's pieces of equal
    length; written once, so that both stay as they are."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(spec)      # the vocabulary file: fixed size

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in piece_batches(batches, shared.value, capacity, eos):
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(nth)],
                names=[*batch.schema.names, "part", "nth"])
    return stored(id_text(docs).mapInArrow(releasing(run), PIECE_SCHEMA + ", part long, nth long"), "pieces")


def length_counts(counted: DataFrame, capacity: int) -> np.ndarray:
    """Pieces of every length: at most ``capacity`` rows reach the driver."""
    out = np.zeros(capacity + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():
        out[length] = n
    return out


def pack_by_patterns(docs: DataFrame, spec: bytes, capacity: int = 2048, eos: int = 0,
                     rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = numbered_pieces(docs, spec, capacity, eos)
    counted = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    plan = docs.sparkSession.sparkContext.broadcast(Plan(length_counts(counted, capacity), rounds))

    def place(batches):
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])
    numbered = pieces.join(base, ["length", "part"]).select(
        "doc_id", F.expr(f"cast(start div {capacity} AS int)").alias("piece"), "start", "length", "ids_crc32",
        (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, SCHEMA)
