"""Catalogue, part 4: state changes, intake, outbox, bulk analysis, copilot pack, sources/sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import intake as IN
from opsdesk.operators import outbox as OB
from opsdesk.operators import resolve as RS
from opsdesk.operators import sla as SLA
from opsdesk.operators import state as ST
from opsdesk.plans import workflow as WF
from opsdesk.plans.catalog_flow import _TEAM_SQL, ENRICH_CTES, _outputs, _strip_sql
from opsdesk.plans.catalog_text import CHUNKS_SQL, CVEC_SQL, best_chunks_sql, vectors_sql
from opsdesk.plans.knowledge import knowledge_index
from opsdesk.plans.registry import query
from opsdesk.session import scratch_path
from opsdesk.sources import csv_intake, documents
from opsdesk.sources.views import AS_OF

_STATUS_LIST = ", ".join(f"'{s}'" for s in LX.STATUSES)


def _blank(x: str) -> str:
    return f"({x} IS NULL OR length({_strip_sql(x)}) = 0)"


def _email_ok(x: str) -> str:
    return f"({_blank(x)} OR regexp_full_match({x}, '{LX.EMAIL_PATTERN}'))"


# ----------------------------------------------------------------------------- U1 / U2 / U8 / U9

@query("status_changes", sql=f"""
WITH l AS (SELECT ticket_id, status, changed_at, count(*) OVER (PARTITION BY ticket_id) AS n,
                  row_number() OVER (PARTITION BY ticket_id ORDER BY changed_at DESC, change_id DESC) AS rn
           FROM status_changes WHERE status IN ({_STATUS_LIST}))
SELECT t.id AS ticket_id, t.status AS old_status, l.status, l.changed_at AS updated_at,
       CASE WHEN l.status IN ('Resolved', 'Closed') THEN l.changed_at END AS resolved_at, l.n AS changes_applied
FROM tickets t JOIN l ON l.ticket_id = t.id AND l.rn = 1""")
def _status_changes(v):
    """U1 + P16: latest valid status change per ticket; resolved_at set or cleared."""
    return ST.apply_status_changes(v.tickets, v.status_changes)["updated"]


@query("status_audit", sql=f"""
SELECT c.ticket_id, '{LX.EV_STATUS}' AS event_type, concat('Ticket status changed to ', c.status, '.') AS description,
       c.changed_at AS created_at
FROM status_changes c WHERE c.status IN ({_STATUS_LIST}) AND c.ticket_id IN (SELECT id FROM tickets)""")
def _status_audit(v):
    """U1 + IO5: one audit event per applied status change."""
    return ST.apply_status_changes(v.tickets, v.status_changes)["audit"]


@query("status_rejects", sql=f"""
SELECT change_id, ticket_id, status, changed_at, '{LX.ERR_STATUS}' AS error FROM status_changes
WHERE status IS NULL OR status NOT IN ({_STATUS_LIST})""")
def _status_rejects(v):
    """Status changes with an unsupported status."""
    return ST.apply_status_changes(v.tickets, v.status_changes)["rejected"]


def routing_history(v):
    """Stored routing recommendations: one per stored analysis, team from the ticket category."""
    t = v.tickets.select(F.col("id").alias("ticket_id"), "category")
    return v.analyses.join(t, "ticket_id", "inner").select(
        F.col("analysis_id").alias("id"), "ticket_id", "created_at",
        RS.team_for(F.col("category")).alias("recommended_team"), F.lit(None).cast("string").alias("recommended_agent"))


@query("accept_routing", sql=f"""
WITH recs AS (SELECT a.analysis_id AS id, a.ticket_id, a.created_at, {_TEAM_SQL} AS recommended_team,
                     CAST(NULL AS VARCHAR) AS recommended_agent
              FROM analyses a JOIN tickets t ON t.id = a.ticket_id),
lat AS (SELECT *, count(*) OVER (PARTITION BY ticket_id) AS n,
               row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS rn FROM recs),
req AS (SELECT DISTINCT ticket_id FROM status_changes WHERE ticket_id IN (SELECT id FROM tickets))
SELECT req.ticket_id, l.recommended_team AS assigned_team,
       CASE WHEN l.ticket_id IS NOT NULL THEN coalesce(l.recommended_agent, '{LX.DEFAULT_AGENT}') END AS assigned_agent,
       CAST(coalesce(l.n, 0) AS BIGINT) AS accepted_recommendations,
       CASE WHEN l.ticket_id IS NULL THEN 'Run AI analysis to create a routing recommendation first.' END AS error
FROM req LEFT JOIN (SELECT * FROM lat WHERE rn = 1) l ON l.ticket_id = req.ticket_id""")
def _accept_routing(v):
    """U2 + W2: accept the latest routing recommendation for requested tickets."""
    return ST.accept_routing(v.tickets, routing_history(v), v.status_changes)


NEW_POLICY = (4, "priority", 2, 24, "2024-01-31 00:00:00")


@query("sla_policy_publish", sql=f"""
SELECT id AS ticket_id, CAST({NEW_POLICY[0]} AS BIGINT) AS policy_id,
       created_at + to_minutes({NEW_POLICY[2] * 60}) AS first_response_due_at,
       created_at + to_minutes({NEW_POLICY[3] * 60}) AS resolution_due_at,
       'on_track' AS first_response_status, 'on_track' AS resolution_status
FROM tickets""")
def _sla_policy_publish(v):
    """U8 → SLA2: publish a new policy (all others deactivated) and re-assign due times."""
    i, n, fh, rh, ts = NEW_POLICY
    new = v.spark.range(1).select(F.lit(i).cast("bigint").alias("id"), F.lit(n).alias("name"),
                                  F.lit(fh).alias("first_response_hours"), F.lit(rh).alias("resolution_hours"),
                                  F.lit(ts).cast("timestamp_ntz").alias("created_at"))
    policies = ST.publish_policy(v.sla_policies, new)
    return SLA.sla_assign(v.tickets, policies)


@query("fk_check", sql="""
SELECT 'tickets.customer_id' AS foreign_key, count(*) AS violations FROM tickets
  WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM customers)
UNION ALL SELECT 'messages.ticket_id', count(*) FROM messages WHERE ticket_id NOT IN (SELECT id FROM tickets)
UNION ALL SELECT 'ticket_sla.ticket_id', count(*) FROM ticket_sla WHERE ticket_id NOT IN (SELECT id FROM tickets)
UNION ALL SELECT 'quality.ticket_id', count(*) FROM quality WHERE ticket_id NOT IN (SELECT id FROM tickets)
UNION ALL SELECT 'audit_events.ticket_id', count(*) FROM audit_events
  WHERE ticket_id IS NOT NULL AND ticket_id NOT IN (SELECT id FROM tickets)""")
def _fk_check(v):
    """Referential checks replacing foreign-key enforcement."""
    t, c = v.tickets, v.customers
    return ST.fk_violations([
        ("tickets.customer_id", t, "customer_id", c, "id"),
        ("messages.ticket_id", v.messages, "ticket_id", t, "id"),
        ("ticket_sla.ticket_id", v.ticket_sla, "ticket_id", t, "id"),
        ("quality.ticket_id", v.quality, "ticket_id", t, "id"),
        ("audit_events.ticket_id", v.audit_events, "ticket_id", t, "id"),
    ])


# ----------------------------------------------------------------------------- intake

_VALIDATE_SQL = f"""
SELECT *, CASE WHEN {_blank('name')} OR {_blank('subject')} OR {_blank('description')} THEN '{LX.ERR_REQUIRED}'
               WHEN NOT {_email_ok('email')} THEN '{LX.ERR_EMAIL}' END AS error FROM requests"""

_CUSTOMERS_SQL = f"""
v AS ({_VALIDATE_SQL}),
ok AS (SELECT * FROM v WHERE error IS NULL),
r AS (SELECT request_id, requested_at, lower({_strip_sql('email')}) AS em, {_blank('email')} AS blank_email FROM ok),
ex AS (SELECT lower({_strip_sql('email')}) AS em, min(id) AS existing_id FROM customers
       WHERE NOT {_blank('email')} GROUP BY 1),
fr AS (SELECT DISTINCT em, first_value(request_id) OVER (PARTITION BY em ORDER BY requested_at, request_id)
         AS first_request FROM r WHERE NOT blank_email),
rc AS (SELECT r.request_id,
              coalesce(CAST(ex.existing_id AS VARCHAR),
                       concat('CUS-', substr(sha256(concat('customer:', CAST(CASE WHEN r.blank_email THEN r.request_id
                                                                          ELSE fr.first_request END AS VARCHAR))),
                                             1, 32))) AS customer_id,
              ex.existing_id IS NULL AND (r.blank_email OR fr.first_request = r.request_id) AS creates_customer
       FROM r LEFT JOIN ex ON ex.em = r.em LEFT JOIN fr ON fr.em = r.em)"""


@query("intake_validate", sql=f"SELECT request_id, error IS NULL AS valid, error FROM ({_VALIDATE_SQL})")
def _intake_validate(v):
    """Request validation with the first failing rule."""
    return IN.validate_requests(v.requests).select("request_id", "valid", "error")


@query("intake_customers", sql=f"WITH {_CUSTOMERS_SQL} SELECT * FROM rc")
def _intake_customers(v):
    """Customer resolution by lower(email) with sequential semantics for new emails."""
    ok = IN.validate_requests(v.requests).where(F.col("valid"))
    return IN.resolve_customers(ok, v.customers)


@query("intake_tickets", sql=f"""
WITH {_CUSTOMERS_SQL}
SELECT concat('SUP-', upper(substr(sha256(concat('ticket:', CAST(ok.request_id AS VARCHAR))), 1, 32))) AS id,
       ok.request_id, rc.customer_id, {_strip_sql('ok.subject')} AS subject,
       {_strip_sql('ok.description')} AS description, ok.channel, 'Open' AS status, 'Medium' AS priority,
       'Moderate' AS severity, '{LX.DEFAULT_AGENT}' AS assigned_agent, ok.requested_at AS created_at
FROM ok JOIN rc ON rc.request_id = ok.request_id""")
def _intake_tickets(v):
    """Tickets created from valid requests."""
    return IN.intake(v.requests, v.customers, v.sla_policies)["tickets"]


_NEW_TICKETS_SQL = f"""{_CUSTOMERS_SQL},
nt AS (SELECT concat('SUP-', upper(substr(sha256(concat('ticket:', CAST(ok.request_id AS VARCHAR))), 1, 32))) AS id,
              ok.request_id, rc.customer_id, rc.creates_customer, ok.name, ok.email, ok.phone,
              {_strip_sql('ok.description')} AS description, ok.channel, ok.requested_at AS created_at
       FROM ok JOIN rc ON rc.request_id = ok.request_id)"""


@query("intake_messages", sql=f"""
WITH {_NEW_TICKETS_SQL}
SELECT id AS ticket_id, customer_id, channel, 'inbound' AS direction, {_strip_sql('name')} AS sender,
       description AS content, 'received' AS delivery_status, created_at FROM nt""")
def _intake_messages(v):
    """The first inbound message of every new ticket."""
    return IN.intake(v.requests, v.customers, v.sla_policies)["messages"]


@query("intake_sla", sql=f"""
WITH {_NEW_TICKETS_SQL},
p AS (SELECT id, first_response_minutes, resolution_minutes FROM sla_policies WHERE active ORDER BY created_at, id LIMIT 1)
SELECT nt.id AS ticket_id, p.id AS policy_id, nt.created_at + to_minutes(p.first_response_minutes) AS first_response_due_at,
       nt.created_at + to_minutes(p.resolution_minutes) AS resolution_due_at,
       'on_track' AS first_response_status, 'on_track' AS resolution_status FROM nt, p""")
def _intake_sla(v):
    """U3 + SLA2: due times of every new ticket."""
    return IN.intake(v.requests, v.customers, v.sla_policies)["ticket_sla"]


@query("intake_new_customers", sql=f"""
WITH {_NEW_TICKETS_SQL}
SELECT customer_id AS id, {_strip_sql('name')} AS name,
       CASE WHEN {_blank('email')} THEN NULL ELSE {_strip_sql('email')} END AS email,
       CASE WHEN {_blank('phone')} THEN NULL ELSE {_strip_sql('phone')} END AS phone, created_at
FROM nt WHERE creates_customer""")
def _intake_new_customers(v):
    """U3 + J9: customers created by the intake."""
    return IN.intake(v.requests, v.customers, v.sla_policies)["customers"]


FEEDBACK_KINDS = ["General feedback", "Feature request", "Bug report", "UI/UX feedback", "AI quality feedback",
                  "RAG/knowledge feedback"]


def feedback_submissions(v):
    r = v.requests
    kinds = F.element_at(F.array(*[F.lit(k) for k in FEEDBACK_KINDS]), (F.col("request_id") % 6 + 1).cast("int"))
    return r.select(F.col("request_id").alias("feedback_id"), "name", "email",
                    F.when(F.col("request_id") % 8 == 0, F.lit(None)).otherwise(F.col("request_id") % 8)
                    .cast("int").alias("rating"), kinds.alias("feedback_type"), F.col("description").alias("message"))


_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in FEEDBACK_KINDS) + "]"


@query("feedback_validate", sql=f"""
WITH f AS (SELECT request_id AS feedback_id, name, email,
                  CAST(CASE WHEN request_id % 8 = 0 THEN NULL ELSE request_id % 8 END AS INTEGER) AS rating,
                  {_KINDS_SQL}[request_id % 6 + 1] AS feedback_type, description AS message FROM requests),
e AS (SELECT *, CASE WHEN {_blank('message')} OR (rating IS NOT NULL AND NOT rating BETWEEN 1 AND 5)
                     THEN '{LX.ERR_FEEDBACK}'
                     WHEN NOT {_email_ok('email')} THEN '{LX.ERR_FEEDBACK_EMAIL}' END AS error FROM f)
SELECT feedback_id, CASE WHEN {_blank('name')} THEN NULL ELSE {_strip_sql('name')} END AS name,
       CASE WHEN {_blank('email')} THEN NULL ELSE {_strip_sql('email')} END AS email, rating, feedback_type,
       {_strip_sql('message')} AS message, 'New' AS status, error, error IS NULL AS valid FROM e""")
def _feedback_validate(v):
    """Feedback validation and clean-up."""
    return IN.validate_feedback(feedback_submissions(v))


# ----------------------------------------------------------------------------- outbox

def _issues_sql(x: str, evidence: str = "FALSE") -> str:
    return f"""list_filter([
        CASE WHEN length({_strip_sql(x)}) < {LX.MIN_DRAFT_LENGTH} THEN '{LX.ISSUE_TOO_SHORT}' END,
        CASE WHEN regexp_matches({x}, '{LX.GUARANTEE_PATTERN}') THEN '{LX.ISSUE_GUARANTEE}' END,
        CASE WHEN regexp_matches({x}, '{LX.CARD_PATTERN}') THEN '{LX.ISSUE_CARD}' END,
        CASE WHEN NOT {evidence} AND regexp_matches({x}, '{LX.POLICY_PATTERN}') THEN '{LX.ISSUE_POLICY}' END],
        lambda i: i IS NOT NULL)"""


def _outbox_sql(source: str, recorded: str | None, p: str = "", evidence: str = "FALSE") -> str:
    """Outbox gates in SQL; CTE names are prefixed with ``p`` so two rounds can coexist;
    ``evidence`` says whether a draft's ticket has evidence."""
    rec_join = f"LEFT JOIN ({recorded}) rk ON rk.idempotency_key = x.idempotency_key" if recorded else ""
    rec_cond = "OR rk.idempotency_key IS NOT NULL" if recorded else ""
    return f"""
{p}d1 AS (SELECT dr.*, t.customer_id, t.id IS NOT NULL AS has_ticket, c.email, c.phone
       FROM {source} dr LEFT JOIN tickets t ON t.id = dr.ticket_id LEFT JOIN customers c ON c.id = t.customer_id),
{p}d2 AS (SELECT *, CASE channel WHEN 'Email' THEN email WHEN 'SMS' THEN phone END AS recipient,
              {_issues_sql('content', evidence)} AS issues FROM {p}d1),
{p}d3 AS (SELECT *, sha256(concat_ws('|', coalesce(CAST(ticket_id AS VARCHAR), 'None'), coalesce(channel, 'None'),
                                  coalesce(recipient, 'None'), coalesce(subject, 'None'),
                                  coalesce({_strip_sql('content')}, 'None'))) AS idempotency_key,
              CASE WHEN NOT coalesce(agent_approved, FALSE) THEN '{LX.GATE_NOT_APPROVED}'
                   WHEN {_blank('content')} THEN '{LX.GATE_BLANK}'
                   WHEN channel IS NULL OR channel NOT IN ('Email', 'SMS') THEN '{LX.GATE_CHANNEL}'
                   WHEN NOT has_ticket THEN '{LX.GATE_NO_TICKET}'
                   WHEN len(issues) > 0 THEN concat('{LX.GATE_UNSAFE}', array_to_string(issues, ' ')) END AS pre_reason
       FROM {p}d2),
{p}fst AS (SELECT DISTINCT idempotency_key,
               first_value(draft_id) OVER (PARTITION BY idempotency_key ORDER BY created_at, draft_id) AS first_draft
        FROM {p}d3 WHERE pre_reason IS NULL),
{p}ob AS (SELECT x.draft_id, x.ticket_id, x.customer_id, x.channel, x.recipient, x.subject, x.content,
              x.idempotency_key, x.created_at,
              coalesce(x.pre_reason, CASE WHEN f.first_draft <> x.draft_id {rec_cond}
                                          THEN '{LX.GATE_REPEAT}' END) AS reject_reason
       FROM {p}d3 x LEFT JOIN {p}fst f ON f.idempotency_key = x.idempotency_key {rec_join})"""


OUTBOX_SQL = _outbox_sql("drafts", None)
_OB_COLS = "draft_id, ticket_id, channel, recipient, idempotency_key, " \
           "CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reject_reason"


def outbox(v, drafts=None, recorded=None):
    return OB.build_outbox(drafts if drafts is not None else v.drafts, v.tickets, v.customers,
                           recorded_keys=recorded)


@query("outbox_build", sql=f"WITH {OUTBOX_SQL} SELECT {_OB_COLS} FROM ob")
def _outbox_build(v):
    """U5 + P19 + CL10: approval gates in order, idempotency key, in-batch repeats."""
    return outbox(v).select("draft_id", "ticket_id", "channel", "recipient", "idempotency_key", "status",
                            "reject_reason")


def analyses_log(v):
    """Stored analyses: one of every ticket by the enrichment, for some tickets followed by one without
    evidence or one whose result is cut off."""
    done = _outputs(v)["analyses"].select("ticket_id", "result_json", "created_at")
    later = done.where("ticket_id % 7 < 2").select(
        "ticket_id", F.when(F.col("ticket_id") % 7 == 0, F.expr("substring(result_json, 1, cast(length(result_json) / 2 AS int))"))
        .otherwise(F.lit('{"category": "Billing", "evidence": []}')).alias("result_json"),
        F.timestamp_add("HOUR", F.lit(1), F.col("created_at")).alias("created_at"))
    return done.unionByName(later)


@query("outbox_with_evidence", sql=f"""
WITH {ENRICH_CTES},
proof AS (SELECT ticket_id FROM enr WHERE evidence_count > 0 AND ticket_id % 7 >= 2),
{_outbox_sql("drafts", None, evidence="(ticket_id IN (SELECT ticket_id FROM proof))")}
SELECT {_OB_COLS} FROM ob""")
def _outbox_with_evidence(v):
    """U5 + CL10: the gates with the evidence of each ticket's latest stored analysis."""
    sent = OB.build_outbox(v.drafts, v.tickets, v.customers, OB.stored_evidence(analyses_log(v)))
    return sent.select("draft_id", "ticket_id", "channel", "recipient", "idempotency_key", "status", "reject_reason")


@query("outbox_dedupe", sql=f"""
WITH first_round AS (SELECT * FROM drafts WHERE review_round = 1),
second_round AS (SELECT * FROM drafts WHERE review_round = 2),
{_outbox_sql("first_round", None, "a")},
recorded AS (SELECT idempotency_key FROM aob WHERE reject_reason IS NULL),
{_outbox_sql("second_round", "SELECT DISTINCT idempotency_key FROM recorded")}
SELECT {_OB_COLS} FROM ob""")
def _outbox_dedupe(v):
    """Second review round against the all-time key log of the first round (left anti)."""
    d = v.drafts
    first = outbox(v, d.where(F.col("review_round") == 1))
    recorded = first.where(F.col("status") == "accepted").select("idempotency_key")
    return outbox(v, d.where(F.col("review_round") == 2), recorded).select("draft_id", "ticket_id", "channel", "recipient",
                                                         "idempotency_key", "status", "reject_reason")


_DELIVER_SQL = f"""
dl AS (SELECT draft_id, ticket_id, channel, recipient, idempotency_key, content,
              CASE WHEN channel = 'Email' THEN 'smtp' ELSE 'sms_gateway' END AS provider,
              substr(subject, 1, {LX.SUBJECT_MAX_CHARS}) AS subject,
              CASE WHEN channel = 'Email' THEN
                     CASE WHEN {_blank('recipient')} THEN 'SMTP host, sender, username, password, or customer email is incomplete.'
                          WHEN NOT regexp_full_match(recipient, '{LX.EMAIL_PATTERN}')
                          THEN 'A valid customer email address is required for SMTP delivery.' END
                   WHEN channel = 'SMS' THEN
                     CASE WHEN {_blank('recipient')} THEN 'SMS gateway settings or customer phone are incomplete.'
                          WHEN NOT regexp_full_match(recipient, '{LX.PHONE_PATTERN.replace(chr(92) + 'd', '[0-9]')}')
                          THEN 'A customer phone number in E.164 format is required for SMS.'
                          WHEN length(content) > {LX.SMS_MAX_CHARS}
                          THEN 'SMS message exceeds the provider''s 1,600-character limit.' END
                   ELSE 'The configured communication provider is not supported for this channel.' END AS deliver_error
       FROM ob WHERE reject_reason IS NULL)"""


def deliverable(v):
    acc = outbox(v).where(F.col("status") == "accepted")
    return OB.check_deliverable(acc, email_provider="smtp", sms_provider="sms_gateway")


@query("deliverable", sql=f"""WITH {OUTBOX_SQL}, {_DELIVER_SQL}
SELECT draft_id, ticket_id, channel, recipient, idempotency_key, provider, subject, deliver_error,
       CASE WHEN deliver_error IS NOT NULL THEN 'failed' ELSE 'ready' END AS delivery_status FROM dl""")
def _deliverable(v):
    """P17 + P18: live-provider contact rules on accepted outbox rows (transport not built)."""
    return deliverable(v)


def _delivery_results(v):
    return deliverable(v).withColumn("delivery_status", F.when(F.col("delivery_status") == "failed", "failed")
                                     .otherwise("sent_to_provider"))


_RESULTS_SQL = f"""{OUTBOX_SQL}, {_DELIVER_SQL},
res AS (SELECT *, CASE WHEN deliver_error IS NOT NULL THEN 'failed' ELSE 'sent_to_provider' END AS delivery_status
        FROM dl)"""


@query("delivery_keys", sql=f"""WITH {_RESULTS_SQL}
SELECT idempotency_key, ticket_id, delivery_status AS status, TIMESTAMP '{AS_OF}' AS created_at FROM res""")
def _delivery_keys(v):
    """Key-log status of every delivery result."""
    return OB.apply_delivery_results(_delivery_results(v), AS_OF)["keys"]


@query("delivery_messages", sql=f"""WITH {_RESULTS_SQL}
SELECT ticket_id, channel, 'outbound' AS direction, 'Support Agent' AS sender, idempotency_key, delivery_status,
       TIMESTAMP '{AS_OF}' AS created_at FROM res WHERE delivery_status <> 'failed'""")
def _delivery_messages(v):
    """Outbound message rows of successful deliveries."""
    return OB.apply_delivery_results(_delivery_results(v), AS_OF)["messages"]


@query("delivery_tickets", sql=f"""WITH {_RESULTS_SQL}
SELECT DISTINCT ticket_id, TIMESTAMP '{AS_OF}' AS updated_at FROM res WHERE delivery_status <> 'failed'""")
def _delivery_tickets(v):
    """Tickets touched by a successful delivery."""
    return OB.apply_delivery_results(_delivery_results(v), AS_OF)["tickets"]


@query("delivery_apply", sql=f"""WITH {OUTBOX_SQL}, {_DELIVER_SQL},
res AS (SELECT *, CASE WHEN deliver_error IS NOT NULL THEN 'failed' ELSE 'sent_to_provider' END AS delivery_status
        FROM dl)
SELECT ticket_id, idempotency_key, '{LX.EV_RECORDED}' AS event_type,
       format('Approved {{}} message recorded with status {{}}.', channel, delivery_status) AS description
FROM res WHERE delivery_status <> 'failed'
UNION ALL SELECT ticket_id, idempotency_key, '{LX.EV_APPROVED}', 'Agent approved the final customer response.'
FROM res WHERE delivery_status <> 'failed'
UNION ALL SELECT ticket_id, idempotency_key, '{LX.EV_VALIDATED}', 'Response validation passed before approval.'
FROM res WHERE delivery_status <> 'failed'
UNION ALL SELECT ticket_id, idempotency_key, '{LX.EV_DELIVERY_FAILED}',
                 format('Approved {{}} could not be accepted by the configured provider.', channel)
FROM res WHERE delivery_status = 'failed'""")
def _delivery_apply(v):
    """Audit events from delivery results (failures write only the failure event)."""
    return OB.apply_delivery_results(_delivery_results(v), AS_OF)["audit"]


@query("human_edited", sql=f"""WITH {OUTBOX_SQL},
la AS (SELECT ticket_id, analysis_id, draft FROM (
         SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, analysis_id DESC) AS rn
         FROM analyses) WHERE rn = 1),
sent AS (SELECT ticket_id, {_strip_sql('content')} AS sent FROM ob WHERE reject_reason IS NULL)
SELECT s.ticket_id, la.analysis_id,
       bool_or(length({_strip_sql('la.draft')}) > 0 AND {_strip_sql('la.draft')} <> s.sent) AS human_edited
FROM sent s JOIN la ON la.ticket_id = s.ticket_id GROUP BY s.ticket_id, la.analysis_id""")
def _human_edited(v):
    """Latest analysis draft differs from the approved, sent text."""
    sent = outbox(v).where(F.col("status") == "accepted").select("ticket_id", "content")
    return OB.human_edited(WF.latest_analysis(v.analyses), sent)


# ----------------------------------------------------------------------------- bulk / copilot

def bulk_rows(v):
    return v.requests.select(F.col("request_id").alias("row_id"), "subject", "description",
                             F.col("name").alias("customer"))


_BULK_SQL = f"""
chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL}),
br AS (SELECT request_id AS row_id, {_strip_sql('subject')} AS s,
              {_strip_sql('description')} AS d,
              coalesce(CAST(name AS VARCHAR), '') AS customer FROM requests),
bc AS (SELECT * FROM ({{classify}})),
bq AS (SELECT DISTINCT concat(s, ' ', d) AS text FROM br WHERE length(s) > 0 AND length(d) > 0),
bv AS ({vectors_sql("bq", "text", "text")}),
bbest AS ({best_chunks_sql("bq", "bv", "text", LX.K_BULK)}),
bhits AS (SELECT bbest.text, count(*) AS n, string_agg(filename, ' | ' ORDER BY rank) AS sources
          FROM bbest JOIN knowledge USING (doc_id) GROUP BY bbest.text),
bulk AS (
  SELECT br.row_id, CASE WHEN ok THEN s ELSE '{LX.BULK_FAILED_SUBJECT}' END AS subject,
         CASE WHEN ok THEN customer END AS customer, CASE WHEN ok THEN bc.category END AS category,
         CASE WHEN ok THEN bc.intent END AS intent, CASE WHEN ok THEN bc.priority END AS priority,
         CASE WHEN ok THEN bc.severity END AS severity, CASE WHEN ok THEN bc.sentiment END AS sentiment,
         CASE WHEN ok THEN bc.confidence END AS confidence,
         CASE WHEN ok THEN CAST(coalesce(bhits.n, 0) AS BIGINT) END AS knowledge_matches,
         CASE WHEN ok THEN bhits.sources END AS knowledge_sources,
         CASE WHEN ok THEN 'rules' END AS analysis_mode,
         CASE WHEN NOT ok THEN '{LX.BULK_ERR_TEXT}' END AS error
  FROM (SELECT *, s IS NOT NULL AND d IS NOT NULL AND length(s) > 0 AND length(d) > 0 AS ok FROM br) br
  JOIN bc ON bc.row_id = br.row_id LEFT JOIN bhits ON bhits.text = concat(br.s, ' ', br.d))"""


def _bulk_sql() -> str:
    from opsdesk.plans.catalog_ops import classify_sql
    return _BULK_SQL.replace("{classify}", classify_sql("s", "d", "br", "row_id"))


@query("bulk_analyze", sql=f"WITH {_bulk_sql()} SELECT * FROM bulk", floats=["confidence"])
def _bulk_analyze(v):
    """CL13: bulk CSV-style analysis of every intake request (single output schema)."""
    return IN.bulk_analyze(bulk_rows(v), knowledge_index(v))


@query("bulk_summary", sql=f"""WITH {_bulk_sql()}
SELECT count(*) AS total_rows, count(*) AS processed_rows, count(*) - count(error) AS successful_rows,
       count(error) AS failed_rows FROM bulk""")
def _bulk_summary(v):
    """Bulk job summary."""
    from opsdesk.operators.metrics import bulk_summary
    return bulk_summary(IN.bulk_analyze(bulk_rows(v), knowledge_index(v)))


@query("copilot_context", sql=f"""
WITH chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL}),
qs AS (SELECT DISTINCT ticket_id AS question_id, ticket_id FROM messages),
tt AS (SELECT t.id AS ticket_id, t.subject, concat(coalesce(t.subject, ''), ' ', coalesce(t.description, '')) AS text,
              sha256(concat(coalesce(t.subject, ''), ' ', coalesce(t.description, ''))) AS th
       FROM tickets t WHERE t.id IN (SELECT ticket_id FROM qs)),
texts AS (SELECT DISTINCT th, text FROM tt WHERE length(trim(text)) > 0),
qv AS ({vectors_sql("texts", "th", "text")}),
qbest AS ({best_chunks_sql("texts", "qv", "th", LX.K_COPILOT)}),
ev AS (SELECT b.th, count(*) AS n, list(ch.content ORDER BY b.rank) AS contents, list(k.filename ORDER BY b.rank) AS sources
       FROM qbest b JOIN chunks ch ON ch.doc_id = b.doc_id AND ch.chunk_index = b.chunk_index
       JOIN knowledge k ON k.doc_id = b.doc_id GROUP BY b.th),
h AS (SELECT ticket_id, count(*) AS history_count,
             string_agg(concat(direction, ': ', content), ' | ' ORDER BY rn DESC) AS history FROM (
        SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS rn
        FROM messages) WHERE rn <= 8 GROUP BY 1)
SELECT qs.question_id, qs.ticket_id, CAST(coalesce(ev.n, 0) AS INTEGER) AS evidence_count,
       CAST(coalesce(h.history_count, 0) AS BIGINT) AS history_count,
       array_to_string(ev.sources, ' | ') AS evidence_sources, array_to_string(ev.contents, ' | ') AS evidence_texts,
       coalesce(h.history, '') AS history,
       concat('Demo copilot: review **', tt.subject, '**. ',
              CASE WHEN ev.n > 0 THEN concat(substr(ev.contents[1], 1, 500), ' (Source: ', ev.sources[1], ')')
                   ELSE 'No matching knowledge evidence was found; verify with the responsible team before advising the customer.'
              END) AS answer
FROM qs JOIN tt ON tt.ticket_id = qs.ticket_id LEFT JOIN ev ON ev.th = tt.th LEFT JOIN h ON h.ticket_id = qs.ticket_id""")
def _copilot_context(v):
    """CL14 + W7: copilot context pack for every ticket with a conversation."""
    questions = v.messages.select(F.col("ticket_id").alias("question_id"), "ticket_id").distinct()
    pack = WF.answer_context(questions, v.tickets, v.messages, knowledge_index(v))
    said = F.transform("history", lambda m: F.concat(m["direction"], F.lit(": "), m["content"]))
    return pack.select("question_id", "ticket_id", "evidence_count", "history_count",
                       F.array_join(F.col("evidence.source"), " | ").alias("evidence_sources"),
                       F.array_join(F.col("evidence.content"), " | ").alias("evidence_texts"),
                       F.coalesce(F.array_join(said, " | "), F.lit("")).alias("history"), "answer")


# ----------------------------------------------------------------------------- sources / sinks

@query("csv_intake", sql="SELECT request_id AS row_id, subject, description, name AS customer FROM requests")
def _csv_intake(v):
    """IO2 + IO3: requests written as a CSV batch with messy headers, read back and normalised."""
    path = scratch_path(v.spark, f"csv-intake-{uuid.uuid4().hex}")
    out = v.requests.select(F.col("request_id").cast("string").alias(" Row_Id "),
                            F.col("subject").alias(" Subject"), F.col("description").alias("DESCRIPTION "),
                            F.col("name").alias("Customer"))
    csv_intake.write_csv(out, path)
    back = csv_intake.read_ticket_csv(v.spark, path)
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), "subject",
                       F.coalesce("description", F.lit("")).alias("description"),
                       F.coalesce("customer", F.lit("")).alias("customer"))


@query("extract_pages", sql="""
WITH s AS (SELECT page_id, url,
  trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
    '{LX.WHITESPACE}+', ' ', 'g')) AS text FROM pages)
SELECT page_id, url, text, CAST(length(text) AS INTEGER) AS n_chars,
       CASE WHEN length(text) > 2000000 THEN 'Extracted knowledge text exceeds the 2 MB character limit.' END AS warning
FROM s""".replace("{LX.WHITESPACE}", LX.WHITESPACE))
def _extract_pages(v):
    """IO4: raw HTML pages to whole plain text; long ones are flagged."""
    return documents.extract_pages(v.table("pages"))
