"""Structured Streaming jobs (ST1-ST5) over the ``events`` stream.

Every job reads the parquet files of ``events`` as a file stream (declared schema) or a stream that
is given, writes to a fresh sink with a checkpoint under the shared ``spark.checkpoint.dir`` and can
run as a long-lived query or with ``trigger(availableNow=True)`` (used by the tests and the
catalogue, which replay the events in several micro-batches and read the finished sink back).

ST1 timeline ingest — stream-static left join + ``dropDuplicatesWithinWatermark``.
ST2 idempotent outbox — ``foreachBatch`` applying the batch gates plus an all-time key log, stored
    by key prefix: a batch reads the prefixes of its own keys only.  Each micro-batch writes to its
    own ``batch_id`` folders with overwrite, so a retried batch replaces its own output.
ST3 ticket volume per day × series — event-time ``window`` count; ``complete`` mode (via
    foreachBatch overwrite) for parity with the batch counts, ``append`` + watermark for
    production (a window is emitted once the watermark passes its end).
ST4 SLA breach alerts — ``transformWithStateInPandas``: the clocks of a bucket of tickets as typed
    value state, an event-time timer for the earliest of them (RocksDB state store).
ST5 streaming intake (U3 in ``foreachBatch``: customers that earlier batches created are known to
    later ones) and stateless classification (CL1 projection, append).

Rows that Spark drops behind the watermark are counted by a listener and appended, per batch and
operator, to the table ``late_rows`` next to the sink.
"""

from __future__ import annotations

import os
import threading
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import is_blank, py_strip
from opsdesk.operators.classify import with_rule_analysis
from opsdesk.operators.intake import intake
from opsdesk.operators.metrics import status_series
from opsdesk.operators.outbox import build_outbox
from opsdesk.session import scratch_path
from opsdesk.sources.tables import SCHEMAS
from opsdesk.sources.views import audit_from, drafts_from, tickets_from


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMAS["events"])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(os.path.join(sf_dir, "events*.parquet"))


REPLAY_ROWS = 25_000         # rows of a file of a replayed part


def replayed(spark: SparkSession, sf_dir: str, table: str = "events", by: str = "ts", parts: int = 3,
             file_rows: int = REPLAY_ROWS) -> DataFrame:
    """A finished table as a stream of ``parts`` micro-batches in the order of ``by`` (for runs to
    completion: the parts are written one after another).  Every part is the same number of files, as
    many as the smallest part fills with ``file_rows`` rows, and a batch takes that many: a batch is
    one part, written and read by many tasks."""
    path = scratch_path(spark, f"replay-{table}-{os.urandom(6).hex()}")
    rows = spark.read.schema(SCHEMAS[table]).parquet(os.path.join(sf_dir, f"{table}.parquet"))
    order = F.col(by).cast("timestamp").cast("double") if "timestamp" in dict(rows.dtypes)[by] else F.col(by).cast("double")
    keyed = rows.withColumn("_by", order)
    cuts = keyed.approxQuantile("_by", [i / parts for i in range(1, parts)], 0.001)
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        within = F.col("_by").isNotNull() if low is None and high is None else F.lit(True)
        if low is not None:
            within = within & (F.col("_by") >= low)
        if high is not None:
            within = within & (F.col("_by") < high)
        ranges.append(within)
    sizes = keyed.agg(*[F.count_if(within).alias(f"n{i}") for i, within in enumerate(ranges)]).first()
    files = max(1, min(sizes) // file_rows)
    for i, within in enumerate(ranges):
        part = keyed.where(within).drop("_by")
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.parquet(os.path.join(path, f"part={i}"))
    return spark.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", files).parquet(os.path.join(path, "*"))


LATE_SCHEMA = "batch_id long, operator int, dropped long"


class LateRows(StreamingQueryListener):
    """Appends the rows that each batch dropped behind the watermark to a table, in any store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.query, self.ended = None, threading.Event()
        self.early: list = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(p.batchId, i, op.numRowsDroppedByWatermark) for i, op in enumerate(p.stateOperators)
                if op.numRowsDroppedByWatermark]
        if rows and self.query is None:
            self.early.append((str(p.id), rows))
        elif rows and str(p.id) == self.query:
            self._write(rows)

    def _write(self, rows: list) -> None:
        self.spark.createDataFrame(rows, LATE_SCHEMA).write.mode("append").parquet(self.path)

    def watch(self, query) -> None:
        self.query = str(query.id)
        for name, rows in self.early:
            if name == self.query:
                self._write(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.ended.set()


def _run(writer, spark: SparkSession, sink: str, available_now: bool = True):
    """Start a query with its late rows recorded; wait for its end when it ends by itself."""
    late = os.path.join(os.path.dirname(sink), "late_rows")
    spark.createDataFrame([], LATE_SCHEMA).write.mode("append").parquet(late)
    listener = LateRows(spark, late)
    if available_now:
        writer = writer.trigger(availableNow=True)
    spark.streams.addListener(listener)
    q = writer.start()
    listener.watch(q)
    if available_now:
        try:
            q.awaitTermination()
            listener.ended.wait(60)          # the listener hears of all batches before the end
        finally:
            spark.streams.removeListener(listener)
    return q


def late_rows(spark: SparkSession, sink: str) -> DataFrame:
    """(batch_id, operator, dropped) of the query that wrote ``sink``."""
    return spark.read.schema(LATE_SCHEMA).parquet(os.path.join(os.path.dirname(sink), "late_rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _locations(spark: SparkSession, name: str, base: str | None) -> tuple[str, str]:
    root = base or scratch_path(spark, f"stream-{name}-{os.urandom(6).hex()}")
    return os.path.join(root, "sink"), os.path.join(root, "checkpoint")


# ----------------------------------------------------------------------------- ST1
def timeline_stream(spark: SparkSession, sf_dir: str, tickets: DataFrame, base: str | None = None,
                    watermark: str = "1 day", available_now: bool = True, events: DataFrame | None = None) -> str:
    """ST1: audit events with a ticket → timeline rows with the ticket's customer."""
    sink, ck = _locations(spark, "timeline", base)
    # watermarks need TIMESTAMP (LTZ); the session is UTC so the cast keeps the instant
    a = audit_from(events if events is not None else events_stream(spark, sf_dir)).where(F.col("ticket_id").isNotNull()) \
        .withColumn("event_time", F.col("created_at").cast("timestamp")) \
        .withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["id"])
    t = tickets.select(F.col("id").alias("ticket_id"), "customer_id")
    out = a.join(t, "ticket_id", "left").select(
        "id", "ticket_id", "customer_id", "event_type", "actor_type", F.col("description").alias("summary"),
        F.lit("{}").alias("metadata_json"), "created_at")
    _run(out.writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink)
         .outputMode("append"), spark, sink, available_now)
    return sink


# ----------------------------------------------------------------------------- ST2
def outbox_stream(spark: SparkSession, sf_dir: str, tickets: DataFrame, customers: DataFrame,
                  base: str | None = None, available_now: bool = True, events: DataFrame | None = None,
                  evidence: DataFrame | None = None) -> str:
    """ST2: drafts arriving as a stream; a key is accepted at most once across all batches."""
    sink, ck = _locations(spark, "outbox", base)
    events = events if events is not None else events_stream(spark, sf_dir)
    drafts = drafts_from(tickets_from(events, spark.read.schema(SCHEMAS["benchmark"])
                                      .parquet(os.path.join(sf_dir, "benchmark.parquet"))))

    def process(batch: DataFrame, batch_id: int) -> None:
        outbox_batch(batch, batch_id, sink, tickets, customers, evidence)

    _run(drafts.writeStream.foreachBatch(process).option("checkpointLocation", ck), spark, sink, available_now)
    return sink


def outbox_batch(batch: DataFrame, batch_id: int, sink: str, tickets: DataFrame, customers: DataFrame,
                 evidence: DataFrame | None = None) -> None:
    """One micro-batch: gates, repeats against the key log, output, then the accepted keys."""
    s = batch.sparkSession
    keylog = os.path.join(os.path.dirname(sink), "keylog")
    prefix = F.substring("idempotency_key", 1, 2).alias("prefix")
    once = os.path.join(os.path.dirname(sink), "gated", f"batch_id={batch_id}")
    build_outbox(batch, tickets, customers, evidence).write.mode("overwrite").parquet(once)
    gated = s.read.parquet(once)
    fresh = gated.where(F.col("status") == "accepted")
    out = gated
    if _exists(s, keylog):                   # the first batch has no log yet
        asked = [r.prefix for r in fresh.select(prefix).distinct().collect()]        # 256 values at most
        known = s.read.schema(KEYLOG_SCHEMA).parquet(keylog).where(F.col("prefix").isin(asked) & (F.col("batch") != batch_id)) \
            .select("idempotency_key").distinct().withColumn("recorded", F.lit(True))
        out = gated.join(known, "idempotency_key", "left")
        repeat = (F.col("status") == "accepted") & F.col("recorded").isNotNull()
        out = out.withColumns({"status": F.when(repeat, "rejected").otherwise(F.col("status")),
                               "reject_reason": F.when(repeat, LX.GATE_REPEAT).otherwise(F.col("reject_reason"))}) \
            .select(*gated.columns)
    out.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))
    s.read.parquet(os.path.join(sink, f"batch_id={batch_id}")).where(F.col("status") == "accepted") \
        .select("idempotency_key", prefix).repartition("prefix").write.mode("overwrite").partitionBy("prefix") \
        .parquet(os.path.join(keylog, f"batch={batch_id}"))


KEYLOG_SCHEMA = "idempotency_key string, batch long, prefix string"


# ----------------------------------------------------------------------------- ST3
def volume_stream(spark: SparkSession, sf_dir: str, base: str | None = None, mode: str = "complete",
                  watermark: str = "1 day", available_now: bool = True, events: DataFrame | None = None) -> str:
    """ST3: tickets per UTC day and series."""
    sink, ck = _locations(spark, "volume", base)
    bench = spark.read.schema(SCHEMAS["benchmark"]).parquet(os.path.join(sf_dir, "benchmark.parquet"))
    t = tickets_from(events if events is not None else events_stream(spark, sf_dir), bench).select(
        F.col("created_at").cast("timestamp").alias("event_time"),  # UTC session: same instant
        status_series(F.col("status")).alias("series")).where(F.col("series").isNotNull())
    if mode == "append":
        t = t.withWatermark("event_time", watermark)
    agg = t.groupBy(F.window("event_time", "1 day").alias("w"), "series").agg(F.count(F.lit(1)).alias("tickets"))
    out = agg.select(F.to_date(F.col("w.start")).alias("day"), "series", "tickets")
    if mode == "append":
        _run(out.writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink)
             .outputMode("append"), spark, sink, available_now)
    else:
        def overwrite(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(sink)
        _run(out.writeStream.outputMode("complete").foreachBatch(overwrite).option("checkpointLocation", ck),
             spark, sink, available_now)
    return sink


# ----------------------------------------------------------------------------- ST4
ALERT_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType()), T.StructField("clock", T.StringType()),
    T.StructField("due_at", T.TimestampNTZType()),
])
STATE_SCHEMA = T.StructType([T.StructField(name, T.BinaryType()) for name in ("ticket", "first", "res", "since", "done")])
UNSET = -(1 << 63)           # no due time
CLOCK_BUCKETS = 4096         # groups of tickets; state and timers are kept per group
KINDS = {"created": 0, "reply": 1, "closed": 2}


class SlaClocks(StatefulProcessor):
    """SLA clocks of the tickets of one bucket: a 'created' event arms a timer per due time, 'reply' /
    'closed' disarm them; a timer whose clock is still armed when the watermark passes it is an alert.

    The clocks of a bucket are packed columns with one place per ticket that is not settled: ticket,
    both due times (microseconds), the first millisecond at which a timer may fire, what is done
    (1: replied, 2: closed).  A batch reads and writes them once and all its tickets are handled
    together; Spark holds one event-time timer per bucket, for the earliest armed clock."""

    CLOCKS = ("first_response", "resolution")
    KINDS_OF = (np.int64, np.int64, np.int64, np.int64, np.int8)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clocks", STATE_SCHEMA)

    def _load(self) -> list[np.ndarray]:
        held = self.state.get() if self.state.exists() else [b""] * len(self.KINDS_OF)
        return [np.frombuffer(bytes(x), kind).copy() for x, kind in zip(held, self.KINDS_OF)]

    @staticmethod
    def _timers(clocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """When the timer of every (clock, ticket) fires, and whether it is armed."""
        _, first, res, since, done = clocks
        due = np.stack([first, res])
        return np.maximum(due // 1000, since), (due != UNSET) & (np.stack([done & 1, done & 2]) == 0)

    def _keep(self, clocks: list[np.ndarray], soonest: int) -> None:
        if not len(clocks[0]):
            if self.state.exists():
                self.state.clear()
            return
        self.state.update(tuple(x.tobytes() for x in clocks))
        at, armed = self._timers(clocks)
        if armed.any():
            self.handle.registerTimer(max(int(at[armed].min()), soonest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        if key[0] is None:
            return iter([])                       # rows without a ticket: no clocks
        events = [pdf[c].to_numpy(np.int64) for c in ("ticket_id", "kind", "first_due", "res_due")]
        old = self._load()
        ticket, kind, first_due, res_due = events
        all_tickets, place = np.unique(np.concatenate([old[0], ticket]), return_inverse=True)
        n, held, at = len(all_tickets), place[:len(old[0])], place[len(old[0]):]
        clocks = [all_tickets, np.full(n, UNSET), np.full(n, UNSET), np.zeros(n, np.int64), np.zeros(n, np.int8)]
        for new, was in zip(clocks[1:], old[1:]):
            new[held] = was
        _, first, res, since, done = clocks
        made = kind == KINDS["created"]
        created = (first != UNSET) | (res != UNSET)
        for due, given in ((first, first_due), (res, res_due)):
            due[at[made]] = UNSET                # a ticket made again: its first known due time counts
            known = np.flatnonzero(made & (given != UNSET))[::-1]
            due[at[known]] = given[known]
        created[at[made]] = True
        for bit, name in ((1, "reply"), (2, "closed")):
            done[at[kind == KINDS[name]]] |= bit
        since[at] = timerValues.getCurrentWatermarkInMs() + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        touched = np.zeros(n, bool)
        touched[at] = True
        settled = touched & created & ~self._timers(clocks)[1].any(0)       # both clocks are met or unset
        self._keep([x[~settled] for x in clocks], 0)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clocks = self._load()
        ticket, first, res, _, done = clocks
        at, armed = self._timers(clocks)
        mark = timerValues.getCurrentWatermarkInMs()
        fired = armed & ((at < mark) | (at <= expiredTimerInfo.getExpiryTimeInMs()))
        clock, who = np.nonzero(fired)
        due = np.stack([first, res])[clock, who]
        for i in range(2):
            done[fired[i]] |= 1 << i
        settled = fired.any(0) & ~self._timers(clocks)[1].any(0)
        alerts = pd.DataFrame({"ticket_id": ticket[who], "clock": np.array(self.CLOCKS, object)[clock],
                               "due_at": pd.Series(due.astype("datetime64[us]"))})
        self._keep([x[~settled] for x in clocks], mark)
        yield alerts

    def close(self) -> None:
        pass


def sla_event_stream(spark: SparkSession, sf_dir: str, replies: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """created / reply / closed events per ticket derived from the events stream; reply times
    come from a static first-reply table (stream-static join)."""
    from opsdesk.sources.views import add_minutes

    bench = spark.read.schema(SCHEMAS["benchmark"]).parquet(os.path.join(sf_dir, "benchmark.parquet"))
    t = tickets_from(events if events is not None else events_stream(spark, sf_dir), bench)
    k = F.col("k")
    has_sla = F.col("id") % 10 != 0
    first_due = F.when(has_sla & (k % 13 != 0), add_minutes(F.col("created_at"), F.lit(60)))
    res_due = F.when(has_sla, add_minutes(F.col("created_at"), 1440 * (1 + k % 40)))
    t = t.join(replies, F.col("id") == replies.ticket_id, "left")
    ev = F.array(
        F.struct(F.lit("created").alias("kind"), F.col("created_at").alias("ts"), first_due.alias("first_due"),
                 res_due.alias("res_due")),
        F.when(F.col("reply_at").isNotNull(),
               F.struct(F.lit("reply").alias("kind"), F.col("reply_at").alias("ts"),
                        F.lit(None).cast("timestamp_ntz").alias("first_due"),
                        F.lit(None).cast("timestamp_ntz").alias("res_due"))),
        F.when(F.col("status").isin("Resolved", "Closed"),
               F.struct(F.lit("closed").alias("kind"), F.col("created_at").alias("ts"),
                        F.lit(None).cast("timestamp_ntz").alias("first_due"),
                        F.lit(None).cast("timestamp_ntz").alias("res_due"))),
    )
    return t.select(F.col("id").alias("ticket_id"), F.inline(F.filter(ev, lambda x: x.isNotNull())))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def sla_stream(spark: SparkSession, sf_dir: str, replies: DataFrame, base: str | None = None,
               watermark: str = "2 hours", available_now: bool = True, events: DataFrame | None = None) -> str:
    """ST4: one alert per ticket and clock when the watermark passes an armed due time."""
    sink, ck = _locations(spark, "sla", base)
    ev = sla_event_stream(spark, sf_dir, replies, events).withColumn("event_time", F.col("ts").cast("timestamp")) \
        .withWatermark("event_time", watermark)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]

    def micros(due):
        return F.coalesce(F.unix_micros(F.col(due).cast("timestamp")), F.lit(UNSET))
    ev = ev.select(F.when(F.col("ticket_id").isNotNull(), F.pmod(F.xxhash64("ticket_id"), F.lit(CLOCK_BUCKETS))).alias("bucket"),
                   "ticket_id", kind.alias("kind"), micros("first_due").alias("first_due"), micros("res_due").alias("res_due"), "event_time")
    alerts = ev.groupBy("bucket").transformWithStateInPandas(SlaClocks(), ALERT_SCHEMA, "Append", "EventTime")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)         # a query keeps the store it was started with
    try:
        _run(alerts.writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink)
             .outputMode("append"), spark, sink, available_now)
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return sink


# ----------------------------------------------------------------------------- ST5
INTAKE_TABLES = ("tickets", "messages", "ticket_sla", "customers", "rejected")


def intake_stream(spark: SparkSession, requests: DataFrame, customers: DataFrame, policies: DataFrame,
                  base: str | None = None, available_now: bool = True) -> dict[str, str]:
    """ST5 + U3: requests arriving as a stream.  Returns the paths of the tables they make.  A batch
    knows the given customers and those that earlier batches created; a retried batch replaces its
    own rows."""
    sink, ck = _locations(spark, "intake", base)

    def process(batch: DataFrame, batch_id: int) -> None:
        intake_batch(batch, batch_id, sink, customers, policies)

    _run(requests.writeStream.foreachBatch(process).option("checkpointLocation", ck), spark, sink, available_now)
    return {name: os.path.join(sink, name) for name in INTAKE_TABLES}


def intake_batch(batch: DataFrame, batch_id: int, sink: str, customers: DataFrame, policies: DataFrame) -> None:
    s = batch.sparkSession
    arrived = os.path.join(os.path.dirname(sink), "arrived", f"batch_id={batch_id}")
    batch.write.mode("overwrite").parquet(arrived)                # the batch feeds five tables
    batch = s.read.schema(batch.schema).parquet(arrived)
    known = customers.where(~is_blank(F.col("email"))).groupBy(F.lower(py_strip(F.col("email"))).alias("email")) \
        .agg(F.min("id").cast("string").alias("id"))
    made = os.path.join(sink, "customers")
    if _exists(s, made):
        earlier = s.read.parquet(made).where(F.col("batch_id") < batch_id)
        known = known.unionByName(earlier.where(F.col("email").isNotNull()).select("id", "email"))
    for name, table in intake(batch, known, policies).items():
        table.write.mode("overwrite").parquet(os.path.join(sink, name, f"batch_id={batch_id}"))


def classify_stream(spark: SparkSession, sf_dir: str, base: str | None = None, available_now: bool = True,
                    events: DataFrame | None = None) -> str:
    """ST5: stateless rule classification of tickets as they arrive."""
    sink, ck = _locations(spark, "classify", base)
    bench = spark.read.schema(SCHEMAS["benchmark"]).parquet(os.path.join(sf_dir, "benchmark.parquet"))
    t = tickets_from(events if events is not None else events_stream(spark, sf_dir), bench)
    a = with_rule_analysis(t.select(F.col("id").alias("ticket_id"), "subject", "description"), "subject",
                           "description")
    out = a.select(
        "ticket_id", "category", "subcategory", "intent", "priority", "severity", "sentiment",
        "customer_impact", "urgency_reason", "confidence",
        F.array_join("missing_information", "; ").alias("missing_info"))
    _run(out.writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink)
         .outputMode("append"), spark, sink, available_now)
    return sink
