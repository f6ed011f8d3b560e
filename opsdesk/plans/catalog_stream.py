"""Catalogue, part 5: streaming jobs over three replayed micro-batches, run to completion
(availableNow) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsdesk.plans.catalog_io import OUTBOX_SQL
from opsdesk.plans.catalog_ops import CLASSIFY_COLS, classify_sql
from opsdesk.plans.registry import REGISTRY, query
from opsdesk.sources.views import requests_from
from opsdesk.streaming import jobs as J


@query("st_timeline", sql="""
SELECT a.id, a.ticket_id, t.customer_id, a.event_type, a.actor_type, a.description AS summary,
       '{}' AS metadata_json, a.created_at
FROM audit_events a LEFT JOIN tickets t ON t.id = a.ticket_id WHERE a.ticket_id IS NOT NULL""")
def _st_timeline(v):
    """ST1: streaming timeline ingest (dedupe within watermark, stream-static join)."""
    return v.spark.read.parquet(J.timeline_stream(v.spark, v.sf_dir, v.tickets, events=J.replayed(v.spark, v.sf_dir)))


@query("st_outbox", sql=f"""
WITH {OUTBOX_SQL}
SELECT draft_id, ticket_id, channel, CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       reject_reason FROM ob""")
def _st_outbox(v):
    """ST2: idempotent outbox stream with an all-time key log (foreachBatch)."""
    sink = J.outbox_stream(v.spark, v.sf_dir, v.tickets, v.customers, events=J.replayed(v.spark, v.sf_dir))
    return v.spark.read.parquet(sink).select("draft_id", "ticket_id", "channel", "status", "reject_reason")


@query("st_volume", sql="""
SELECT CAST(created_at AS DATE) AS day,
       CASE WHEN status IN ('Open', 'In Progress', 'Pending') THEN 'Open tickets'
            WHEN status IN ('Resolved', 'Closed') THEN 'Resolved' WHEN status = 'Escalated' THEN 'Escalated' END
         AS series, count(*) AS tickets
FROM tickets GROUP BY 1, 2""")
def _st_volume(v):
    """ST3: live ticket volume per day and series (complete mode = batch counts)."""
    return v.spark.read.parquet(J.volume_stream(v.spark, v.sf_dir, events=J.replayed(v.spark, v.sf_dir)))


@query("st_sla", sql="""
WITH replies AS (SELECT ticket_id, min(created_at) AS reply_at FROM messages WHERE direction = 'outbound' GROUP BY 1),
mark AS (SELECT date_trunc('millisecond', greatest((SELECT max(created_at) FROM tickets),
                (SELECT max(reply_at) FROM replies JOIN tickets ON tickets.id = ticket_id))) - INTERVAL 1 DAY AS w)
SELECT s.ticket_id, 'first_response' AS clock, s.first_response_due_at AS due_at
FROM ticket_sla s LEFT JOIN replies r ON r.ticket_id = s.ticket_id, mark
WHERE r.ticket_id IS NULL AND s.first_response_due_at < mark.w
UNION ALL
SELECT s.ticket_id, 'resolution', s.resolution_due_at FROM ticket_sla s JOIN tickets t ON t.id = s.ticket_id, mark
WHERE t.status NOT IN ('Resolved', 'Closed') AND s.resolution_due_at < mark.w""")
def _st_sla(v):
    """ST4: SLA breach alerts from per-ticket event-time timers, behind the final watermark of one day."""
    replies = v.messages.where(F.col("direction") == "outbound").groupBy("ticket_id") \
        .agg(F.min("created_at").alias("reply_at"))
    return v.spark.read.parquet(J.sla_stream(v.spark, v.sf_dir, replies, watermark="1 day", events=J.replayed(v.spark, v.sf_dir)))


@query("st_classify", sql=f"""
SELECT id AS ticket_id, {', '.join(CLASSIFY_COLS)}, array_to_string(missing_information, '; ') AS missing_info
FROM ({classify_sql('subject', 'description', 'tickets', 'id')})""", floats=["confidence"])
def _st_classify(v):
    """ST5: streaming rule classification."""
    return v.spark.read.parquet(J.classify_stream(v.spark, v.sf_dir, events=J.replayed(v.spark, v.sf_dir)))


def _intake(v, name: str):
    requests = requests_from(J.replayed(v.spark, v.sf_dir, "customer", "c_custkey"))
    return v.spark.read.parquet(J.intake_stream(v.spark, requests, v.customers, v.sla_policies)[name]).drop("batch_id")


@query("st_intake", sql=REGISTRY["intake_tickets"].sql)
def _st_intake(v):
    """ST5 + U3: tickets made from requests that arrive as a stream; equal to the batch intake."""
    return _intake(v, "tickets")


@query("st_intake_customers", sql=REGISTRY["intake_new_customers"].sql)
def _st_intake_customers(v):
    """ST5 + U3 + J9: customers that the streaming intake creates, once over all batches."""
    return _intake(v, "customers")
