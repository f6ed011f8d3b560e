"""Enrichment of a few own tickets: categories, evidence, tool gate, channels, escalation, audit."""

import datetime as dt

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import retrieve as R
from opsdesk.plans import workflow as WF
from test_rules import SENTENCES

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
SEED = [x[:3] for x in SENTENCES[:6]]
CHANNELS = {"paid-plan": "Email", "sign-in": "Web", "receipts": "SMS", "pdf": "Email", "wish": "Web", "twice": "Email"}
STATUS = {"pdf": "Resolved", "twice": "Escalated"}
CUSTOMER = {"paid-plan": 11, "sign-in": 12, "receipts": 13, "pdf": 11, "wish": 14, "twice": 12}


def _fixture(spark):
    ages = [1, 5, 8, 20, 30, 50]
    tickets = spark.createDataFrame(
        [(tid, CUSTOMER[tid], s, d, CHANNELS[tid], STATUS.get(tid, "Open"), NOW - dt.timedelta(hours=a))
         for (tid, s, d), a in zip(SEED, ages)],
        "id string, customer_id long, subject string, description string, channel string, status string, "
        "created_at timestamp_ntz")
    customers = spark.createDataFrame([(11, "Ada"), (12, "Ben"), (13, "Cy")], "id long, name string")
    docs = spark.createDataFrame([
        (1, "plans.txt", "guide", "An upgrade is billed on the day it is ordered. When the old limits still apply, check "
                                  "whether the bank has settled the entry."),
        (2, "access.txt", "guide", "Every login needs the passphrase and a code. A code is valid for ten minutes."),
    ], "doc_id long, filename string, document_type string, text string")
    sla = spark.createDataFrame([(t, NOW - dt.timedelta(hours=a) + dt.timedelta(hours=48))
                                 for (t, _, _), a in zip(SEED, ages)],
                                "ticket_id string, resolution_due_at timestamp_ntz") \
        .withColumn("first_response_status", F.lit("on_track"))
    return tickets, customers, docs, sla


def test_enrichment_golden(spark):
    tickets, customers, docs, sla = _fixture(spark)
    chunks = R.chunk_documents(R.by_document(docs))
    meta = R.chunk_documents(docs, keep=["filename", "document_type"])
    e = {r.ticket_id: r for r in WF.enrich_tickets(tickets, customers, R.ChunkCorpus(chunks, meta), sla, NOW).collect()}
    t = e["paid-plan"]
    assert t.category == "Billing" and t.evidence_count > 0
    assert t.mcp_used and t.mcp_succeeded
    assert t.problem_summary.startswith("Subscription or payment issue: ")
    assert t.routing.team == "Billing Team"
    assert e["wish"].category == "Feedback" and not e["wish"].mcp_used
    assert e["receipts"].draft == LX.DRAFT_SMS                       # SMS variant
    assert e["twice"].escalation_required                         # Critical severity
    assert e["sign-in"].mcp_succeeded                               # customer 12 exists


def test_enrichment_outputs_and_audit(spark):
    tickets, customers, docs, sla = _fixture(spark)
    chunks = R.chunk_documents(R.by_document(docs))
    meta = R.chunk_documents(docs, keep=["filename", "document_type"])
    e = WF.enrich_tickets(tickets, customers, R.ChunkCorpus(chunks, meta), sla, NOW)
    out = WF.split_outputs(e, None, NOW)
    assert out["quality"].count() == 6 and out["routing"].count() == 6
    events = {(r.ticket_id, r.event_type) for r in out["audit"].collect()}
    assert ("paid-plan", LX.EV_ANALYSIS) in events and ("paid-plan", LX.EV_TOOL) in events
    assert ("twice", LX.EV_ESCALATION) in events


def test_evidence_is_kept_per_text(spark):
    tickets, customers, docs, sla = _fixture(spark)
    twice = tickets.unionByName(tickets.withColumn("id", F.concat("id", F.lit("-again"))))
    corpus = R.ChunkCorpus(R.chunk_documents(docs), R.chunk_documents(docs, keep=["filename", "document_type"]))
    rows, evidence = WF.enrich_parts(twice, customers, corpus, sla, NOW)
    assert "evidence" not in rows.columns and rows.count() == 12 and evidence.count() == 6
    whole = {r.ticket_id: r for r in WF.with_evidence(rows, evidence).collect()}
    assert all(whole[t].evidence == whole[f"{t}-again"].evidence and whole[t].similar_count >= 1 for t in ("paid-plan", "wish"))


def test_tickets_of_one_id_are_ranked_together(spark):
    from opsdesk.operators.similar import similar_tickets
    rows = [(i // 2 if i < 4 else i, None, f"a reset link that expired {i % 2}", "Open", NOW) for i in range(24)]
    out = similar_tickets(spark.createDataFrame(rows, "id long, subject string, description string, status string, created_at timestamp_ntz"))
    assert "similar_counts" in out
    ranks = {}
    for r in out["similar"].collect():
        assert r.ticket_id != r.matched_ticket_id
        ranks.setdefault(r.ticket_id, []).append(r.rank)
    assert all(sorted(x) == list(range(1, 9)) for x in ranks.values()) and len(ranks) == 22
    assert {r.ticket_id: r.similar_count for r in out["similar_counts"].collect()} == {t: 8 for t in ranks}
