"""Streaming jobs equal the batch operators over the same finished input."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from opsdesk.plans.compare import rows_of
from opsdesk.session import scratch_path
from opsdesk.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_classify_stream_equals_batch(spark, views):
    from opsdesk.plans.catalog import all_queries
    q = all_queries()
    a = q["st_classify"].run(spark, SF)
    b = q["classify"].run(spark, SF)
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.select(*a.columns).collect())


def test_volume_stream_equals_batch(spark, views):
    from opsdesk.operators.metrics import status_series
    s = spark.read.parquet(J.volume_stream(spark, SF))
    b = views.tickets.select(F.to_date("created_at").alias("day"), status_series(F.col("status")).alias("series")) \
        .groupBy("day", "series").count().withColumnRenamed("count", "tickets")
    assert rows_of(s.columns, s.collect()) == rows_of(b.columns, b.select(*s.columns).collect())


def test_sla_alerts_only_for_unmet_clocks(spark, views):
    replies = views.messages.where(F.col("direction") == "outbound").groupBy("ticket_id") \
        .agg(F.min("created_at").alias("reply_at"))
    alerts = spark.read.parquet(J.sla_stream(spark, SF, replies))
    replied = {r.ticket_id for r in replies.collect()}
    closed = {r.id for r in views.tickets.where(F.col("status").isin("Resolved", "Closed")).collect()}
    rows = alerts.collect()
    assert rows
    for r in rows:
        if r.clock == "first_response":
            assert r.ticket_id not in replied
        else:
            assert r.ticket_id not in closed
    assert alerts.groupBy("ticket_id", "clock").count().where("count > 1").count() == 0


def test_outbox_stream_accepts_each_key_once(spark, views):
    out = spark.read.parquet(J.outbox_stream(spark, SF, views.tickets, views.customers))
    acc = out.where(F.col("status") == "accepted")
    assert acc.count() > 0
    assert acc.groupBy("idempotency_key").count().where("count > 1").count() == 0


def _stream_of(spark, parts, schema):
    """A stream with one batch per given list of rows."""
    path = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(path, f"part={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(path, "*"))


def _event(i, day, hour=0, k=1):
    return (i, dt.datetime(2024, 1, day, hour), 1, "click", 1.0, f'{{"k": {k}}}')


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_timeline_counts_every_late_row(spark, views):
    batches = [[_event(1, 1), _event(2, 10)], [_event(3, 2), _event(4, 3), _event(5, 11), _event(5, 11)],
               [_event(6, 1), _event(7, 1), _event(8, 4), _event(10, 10), _event(12, 12), _event(2, 10)],
               [_event(13, 9), _event(9, 13)]]
    sink = J.timeline_stream(spark, SF, views.tickets, events=_stream_of(spark, batches, EVENTS))
    # a batch's rows are late behind the watermark that the batch before it ran with
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4, 5, 9, 10, 12]
    late = {}
    for r in J.late_rows(spark, sink).collect():
        late[r.batch_id] = late.get(r.batch_id, 0) + r.dropped
    assert late == {2: 3, 3: 1}


def test_jobs_without_late_rows_leave_an_empty_table(spark, views):
    replies = spark.createDataFrame([], "ticket_id long, reply_at timestamp_ntz")
    sink = J.sla_stream(spark, SF, replies)
    assert J.late_rows(spark, sink).count() == 0
    assert set(spark.read.parquet(sink).columns) == {"ticket_id", "clock", "due_at"}


def test_sla_timers_over_several_batches(spark):
    """Armed in one batch, fired by a later watermark; a reply in between disarms."""
    none = spark.createDataFrame([], "ticket_id long, reply_at timestamp_ntz")
    batches = [[_event(1, 1, 0, k=3), _event(2, 1, 1, k=3)], [_event(3, 3, 0, k=6)], [_event(4, 20, 0, k=1)], [_event(5, 21, 0, k=1)]]
    replies = spark.createDataFrame([(2, dt.datetime(2024, 1, 1, 2))], "ticket_id long, reply_at timestamp_ntz")
    for rep, first in ((none, {1, 2, 3}), (replies, {1, 3})):
        sink = J.sla_stream(spark, SF, rep, watermark="1 hour", events=_stream_of(spark, batches, EVENTS))
        got = {(r.ticket_id, r.clock): r.due_at for r in spark.read.parquet(sink).collect()}
        assert {t for t, c in got if c == "first_response" and t < 4} == first
        assert got[(1, "first_response")] == dt.datetime(2024, 1, 1, 1)


def test_a_key_is_accepted_once_over_all_batches_and_a_retry_changes_nothing(spark, views):
    drafts = views.drafts.where("agent_approved AND channel = 'Email'")
    first, second = drafts.where("ticket_id % 9 = 0"), drafts.where("ticket_id % 9 <= 3")
    sink = os.path.join(scratch_path(spark, f"test-outbox-{uuid.uuid4().hex}"), "sink")

    def state():
        return sorted(map(tuple, spark.read.parquet(sink).select("batch_id", "draft_id", "status", "reject_reason").collect()), key=str)
    for batch_id, batch in enumerate((first, second, first)):
        J.outbox_batch(batch, batch_id, sink, views.tickets, views.customers)
    out = spark.read.parquet(sink)
    accepted = out.where("status = 'accepted'")
    assert accepted.count() > 0 and accepted.count() == accepted.select("idempotency_key").distinct().count()
    assert accepted.where("batch_id = 2").count() == 0 and accepted.where("batch_id = 1").count() > 0
    before, keys = state(), accepted.count()
    J.outbox_batch(second, 1, sink, views.tickets, views.customers)
    assert state() == before
    log = spark.read.parquet(os.path.join(os.path.dirname(sink), "keylog"))
    assert log.count() == keys and log.where("prefix <> substring(idempotency_key, 1, 2)").count() == 0


def test_intake_over_three_batches_equals_the_batch_intake(spark, views):
    from opsdesk.operators.intake import intake
    from opsdesk.sources.views import requests_from
    want = intake(views.requests, views.customers, views.sla_policies)
    paths = J.intake_stream(spark, requests_from(J.replayed(spark, SF, "customer", "c_custkey")), views.customers, views.sla_policies)
    assert spark.read.parquet(paths["tickets"]).select("batch_id").distinct().count() == 3
    for name, path in paths.items():
        got = spark.read.parquet(path).drop("batch_id")
        cols = sorted(want[name].columns)
        assert sorted(got.columns) == cols
        assert rows_of(cols, got.select(*cols).collect()) == rows_of(cols, want[name].select(*cols).collect()), name


def test_volume_stream_append_mode_emits_final_counts(spark, views):
    from opsdesk.operators.metrics import status_series
    s = spark.read.parquet(J.volume_stream(spark, SF, mode="append", watermark="1 hour"))
    rows = s.collect()
    assert rows, "closed windows are emitted"
    b = views.tickets.select(F.to_date("created_at").alias("day"), status_series(F.col("status")).alias("series")) \
        .groupBy("day", "series").count().collect()
    batch = {(r.day, r.series): r["count"] for r in b}
    for r in rows:
        assert batch[(r.day, r.series)] == r.tickets


def test_sla_alerts_equal_batch_expectation(spark, views):
    """Exact: an alert exists iff the clock is armed, not disarmed, and its due time is
    behind the final watermark (max event time − 2 h)."""
    import datetime as dt
    replies = views.messages.where(F.col("direction") == "outbound").groupBy("ticket_id") \
        .agg(F.min("created_at").alias("reply_at"))
    alerts = {(r.ticket_id, r.clock) for r in spark.read.parquet(J.sla_stream(spark, SF, replies)).collect()}
    rep = {r.ticket_id: r.reply_at for r in replies.collect()}
    t = views.tickets.select("id", "status", "created_at", "k").collect()
    sla = {r.ticket_id: r for r in views.ticket_sla.collect()}
    times = [r.created_at for r in t] + [rep[r.id] for r in t if r.id in rep]
    wm = max(times) - dt.timedelta(hours=2)
    expected = set()
    for r in t:
        s = sla.get(r.id)
        if s is None:
            continue
        if s.first_response_due_at is not None and r.id not in rep and s.first_response_due_at < wm:
            expected.add((r.id, "first_response"))
        if r.status not in ("Resolved", "Closed") and s.resolution_due_at < wm:
            expected.add((r.id, "resolution"))
    assert alerts == expected and expected


def test_outbox_stream_equals_batch_outbox(spark, views):
    from opsdesk.operators.outbox import build_outbox
    s = spark.read.parquet(J.outbox_stream(spark, SF, views.tickets, views.customers))
    b = build_outbox(views.drafts, views.tickets, views.customers)
    cols = ["draft_id", "ticket_id", "channel", "status", "reject_reason"]
    assert rows_of(cols, s.select(*cols).collect()) == rows_of(cols, b.select(*cols).collect())


def test_replayed_parts_are_many_files_and_one_batch_each(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 7 % 900), 1, "click", 1.0, None) for i in range(900)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    sink, seen = scratch_path(spark, f"test-replay-{uuid.uuid4().hex}"), []

    def process(batch, batch_id):
        seen.append(tuple(batch.withColumn("file", F.input_file_name()).agg(F.count_distinct("file"), F.count("*"), F.min("ts"), F.max("ts")).first()))
    J.replayed(spark, str(tmp_path), file_rows=50).writeStream.foreachBatch(process) \
        .option("checkpointLocation", sink).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for _, n, _, _ in seen) == 900
    assert len({files for files, *_ in seen}) == 1 and seen[0][0] > 1
    assert seen[0][3] < seen[1][2] and seen[1][3] < seen[2][2]


def test_sla_clocks_share_state_and_a_timer_by_bucket(spark, monkeypatch):
    """One bucket for all tickets: armed, disarmed, fired one after another, made again."""
    monkeypatch.setattr(J, "CLOCK_BUCKETS", 1)
    batches = [[_event(1, 1, 0, k=3), _event(2, 1, 1, k=3), _event(11, 1, 2, k=6)], [_event(3, 3, 0, k=6), _event(1, 3, 1, k=3)],
               [_event(4, 20, 0, k=1)], [_event(5, 21, 0, k=1)]]
    replies = spark.createDataFrame([(2, dt.datetime(2024, 1, 1, 2))], "ticket_id long, reply_at timestamp_ntz")
    sink = J.sla_stream(spark, SF, replies, watermark="1 hour", events=_stream_of(spark, batches, EVENTS))
    got = sorted((r.ticket_id, r.clock, r.due_at) for r in spark.read.parquet(sink).collect())
    day = dt.datetime(2024, 1, 1)
    assert [x for x in got if x[1] == "first_response"] == [
        (1, "first_response", day + dt.timedelta(days=2, hours=2)), (3, "first_response", day + dt.timedelta(days=2, hours=1)),
        (4, "first_response", day + dt.timedelta(days=19, hours=1)), (11, "first_response", day + dt.timedelta(hours=3))]
    assert [x[:2] for x in got if x[1] == "resolution"] == [(3, "resolution"), (11, "resolution")]
