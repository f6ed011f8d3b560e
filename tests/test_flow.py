"""Outbox gates, intake semantics, bulk analysis, status changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import intake as IN
from opsdesk.operators import outbox as OB
from opsdesk.operators import state as ST

T0 = dt.datetime(2024, 1, 10, 9, 0, 0)


def _tickets(spark):
    return spark.createDataFrame([(1, 10, "Email"), (2, 20, "SMS")], "id long, customer_id long, channel string")


def _customers(spark):
    return spark.createDataFrame([(10, "a@example.test", "+15550000010"), (20, None, "+15550000020")],
                                 "id long, email string, phone string")


def _drafts(spark, rows):
    return spark.createDataFrame(
        [(i, t, c, ch, "Support update", ap, T0 + dt.timedelta(minutes=i)) for i, t, c, ch, ap in rows],
        "draft_id long, ticket_id long, content string, channel string, subject string, agent_approved boolean, "
        "created_at timestamp_ntz")


SAFE = "A colleague reads your case today and writes back."


def test_outbox_gate_order(spark):
    d = _drafts(spark, [
        (1, 1, SAFE, "Email", False),
        (2, 1, "   ", "Email", True),
        (3, 1, SAFE, "Web", True),
        (4, 9, SAFE, "Email", True),
        (5, 1, "It is certain: your refund is guaranteed by us today.", "Email", True),
        (6, 1, SAFE, "Email", True),
        (7, 1, SAFE + "  ", "Email", True),
        (8, 2, SAFE, "SMS", True),
    ])
    out = {r.draft_id: r for r in OB.build_outbox(d, _tickets(spark), _customers(spark)).collect()}
    assert out[1].reject_reason == LX.GATE_NOT_APPROVED
    assert out[2].reject_reason == LX.GATE_BLANK
    assert out[3].reject_reason == LX.GATE_CHANNEL
    assert out[4].reject_reason == LX.GATE_NO_TICKET
    assert out[5].reject_reason.startswith(LX.GATE_UNSAFE)
    assert out[6].status == "accepted" and out[6].recipient == "a@example.test"
    assert out[7].reject_reason == LX.GATE_REPEAT  # same key after strip
    assert out[8].status == "accepted" and out[8].recipient == "+15550000020"


def test_repeat_after_failed_attempt_is_rejected(spark):
    d = _drafts(spark, [(1, 1, SAFE, "Email", True)])
    first = OB.build_outbox(d, _tickets(spark), _customers(spark))
    failed = OB.check_deliverable(first, email_provider="unsupported")
    assert failed.first().delivery_status == "failed"
    again = OB.build_outbox(_drafts(spark, [(2, 1, SAFE, "Email", True)]), _tickets(spark), _customers(spark),
                            recorded_keys=first.select("idempotency_key"))
    assert again.first().reject_reason == LX.GATE_REPEAT


def test_intake_sequential_customer_semantics(spark):
    existing = spark.createDataFrame([(1, "Old", "Known@Example.test", None)],
                                     "id long, name string, email string, phone string")
    req = spark.createDataFrame([
        (1, "Ann", "known@example.test", "S", "D", "Email", "", T0),
        (2, "Bob", "new@x.test", "S", "D", "Email", "", T0 + dt.timedelta(seconds=1)),
        (3, "Bob2", "NEW@x.test", "S", "D", "Email", "", T0 + dt.timedelta(seconds=2)),
        (4, "Cy", "", "S", "D", "Email", "", T0),
        (5, "Di", "", "S", "D", "Email", "", T0),
        (6, "", "e@x.test", "S", "D", "Email", "", T0),
        (7, "Ed", "bad@@x", "S", "D", "Email", "", T0),
    ], "request_id long, name string, email string, subject string, description string, channel string, "
       "phone string, requested_at timestamp_ntz")
    ok = IN.validate_requests(req)
    errs = {r.request_id: r.error for r in ok.collect()}
    assert errs[6] == LX.ERR_REQUIRED and errs[7] == LX.ERR_EMAIL and errs[1] is None
    cust = {r.request_id: r for r in IN.resolve_customers(ok.where("valid"), existing).collect()}
    assert cust[1].customer_id == "1" and not cust[1].creates_customer
    assert cust[2].customer_id == cust[3].customer_id and cust[2].creates_customer and not cust[3].creates_customer
    assert cust[4].customer_id != cust[5].customer_id and cust[4].creates_customer and cust[5].creates_customer


def _corpus(spark, chunks):
    from opsdesk.operators.retrieve import ChunkCorpus
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index int, content string")
    meta = df.withColumn("filename", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))) \
        .withColumn("document_type", F.lit("guide"))
    return ChunkCorpus(df, meta)


def test_bulk_blank_row_fails_without_echo_and_cap(spark):
    rows = spark.createDataFrame([(1, "Two entries on one bill", "The bank shows a payment that was charged twice", None),
                                  (2, "", "The bank has settled it", None)],
                                 "row_id long, subject string, description string, customer string")
    corpus = _corpus(spark, [(1, 0, "bank payment"), (1, 1, "y"), (2, 0, "z")])
    out = {r.row_id: r for r in IN.bulk_analyze(rows, corpus).collect()}
    assert out[1].knowledge_sources.split(" | ")[0] == "f1.txt" and out[2].knowledge_sources is None
    assert out[1].category == "Billing" and out[1].knowledge_matches == 2 and out[1].error is None
    assert out[2].subject == LX.BULK_FAILED_SUBJECT and out[2].error == LX.BULK_ERR_TEXT
    assert "The bank has settled it" not in str(out[2].asDict())
    big = spark.range(5001).select(F.col("id").alias("row_id"), F.lit("x").alias("subject"),
                                   F.lit("y").alias("description"), F.lit(None).cast("string").alias("customer"))
    with pytest.raises(ValueError, match="5,000-row limit"):
        IN.bulk_analyze(big, corpus, max_rows=5000)


def test_status_change_reopen_clears_resolved_at(spark):
    t = spark.createDataFrame([(1, "Open")], "id long, status string")
    ch = spark.createDataFrame([(11, 1, "Resolved", T0), (12, 1, "Open", T0 + dt.timedelta(hours=1)),
                                (13, 1, "Bogus", T0 + dt.timedelta(hours=2))],
                               "change_id long, ticket_id long, status string, changed_at timestamp_ntz")
    out = ST.apply_status_changes(t, ch)
    u = out["updated"].first()
    assert u.status == "Open" and u.resolved_at is None and u.changes_applied == 2
    assert out["rejected"].first().error == LX.ERR_STATUS


def test_feedback_rating_optional(spark):
    f = spark.createDataFrame([(1, "", "", None, "General feedback", "A note without a score"),
                               (2, "x", "a@b.c", 7, "Bug report", "bad rating")],
                              "feedback_id long, name string, email string, rating int, feedback_type string, "
                              "message string")
    r = {x.feedback_id: x for x in IN.validate_feedback(f).collect()}
    assert r[1].valid and r[1].rating is None and r[1].name is None
    assert not r[2].valid


def test_bulk_progress_via_observation(spark):
    from pyspark.sql import Observation
    rows = spark.createDataFrame([(1, "Two entries on one bill", "It was charged twice", None), (2, " ", "x", None),
                                  (3, "Login", "cannot sign in", "Ann")],
                                 "row_id long, subject string, description string, customer string")
    corpus = _corpus(spark, [(1, 0, "x")])
    obs = Observation("bulk")
    IN.bulk_analyze(rows, corpus, observation=obs).write.format("noop").mode("overwrite").save()
    assert obs.get == {"processed": 3, "failed": 1}


def test_latest_evidence_without_shuffling_results(spark):
    yes, no = '{"evidence": [{"content": "x"}]}', '{"evidence": []}'
    rows = [(1, no, T0), (1, yes, T0 + dt.timedelta(hours=1)), (2, yes, T0), (2, no, T0 + dt.timedelta(hours=1)),
            (3, yes, T0), (3, '{"evidence": [{"cont', T0 + dt.timedelta(hours=1)), (4, None, T0)]
    schema = "ticket_id long, result_json string, created_at timestamp_ntz"
    out = OB.stored_evidence(spark.createDataFrame(rows, schema))
    assert "max_by(result_json" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.ticket_id: r.has_evidence for r in out.collect()} == {1: True, 2: False, 3: False, 4: False}
    tied = OB.stored_evidence(spark.createDataFrame(rows + [(5, yes, T0), (5, no, T0), (6, no, T0), (6, "z", T0)], schema))
    assert {r.ticket_id: r.has_evidence for r in tied.collect()} == {1: True, 2: False, 3: False, 4: False, 5: yes > no, 6: False}
