"""Catalogue, part 1: queue views, aggregates, SLA and rule classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import classify as CL
from opsdesk.operators import metrics as M
from opsdesk.operators import queue as Q
from opsdesk.operators import sla as SLA
from opsdesk.plans.registry import query
from opsdesk.sources.views import AS_OF

BRIEF_AS_OF = "2024-01-30 18:00:00"
TICKET_COLS = ["id", "customer_id", "subject", "description", "channel", "status", "category", "priority",
               "severity", "sentiment", "created_at"]
_TCOLS_SQL = ", ".join(f"t.{c}" for c in TICKET_COLS)
_AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
_PRANK_SQL = "CAST(CASE {p}priority WHEN 'Urgent' THEN 0 WHEN 'High' THEN 1 ELSE 2 END AS BIGINT)"
_S1_SQL = "CASE {p}priority WHEN 'Urgent' THEN 0 WHEN 'High' THEN 1 ELSE 2 END, {p}created_at DESC, {p}id"
_OPEN_SQL = "{p}status NOT IN ('Resolved', 'Closed')"
_UNCLASSIFIED_SQL = "coalesce(nullif({p}category, ''), 'Unclassified')"


def s1(p: str = "") -> str:
    return _S1_SQL.format(p=p)


def tickets_v(v):
    return v.tickets.select(*TICKET_COLS)


def sla_states(v, as_of=AS_OF):
    return SLA.sla_state(v.tickets, v.ticket_sla, v.messages, as_of)


def _clock_sql(due: str, risk_s: int, done: str) -> str:
    left = f"date_diff('microsecond', {_AS_OF_SQL}, {due})"
    return (f"CASE WHEN {done} THEN 'met' WHEN {due} IS NULL THEN 'not_configured' WHEN {left} < 0 THEN 'breached' "
            f"WHEN {left} <= {risk_s * 1_000_000} THEN 'at_risk' ELSE 'on_track' END")


SLA_STATE_SQL = f"""
SELECT s.ticket_id, t.status AS ticket_status, s.first_response_due_at, s.resolution_due_at,
       {_clock_sql('s.first_response_due_at', 3600, 'r.ticket_id IS NOT NULL')} AS first_response_status,
       {_clock_sql('s.resolution_due_at', 21600, "t.status IN ('Resolved', 'Closed')")} AS resolution_status
FROM ticket_sla s JOIN tickets t ON t.id = s.ticket_id
LEFT JOIN (SELECT DISTINCT ticket_id FROM messages WHERE direction = 'outbound') r ON r.ticket_id = s.ticket_id"""

# ----------------------------------------------------------------------------- IO1 / P / J / S / W


@query("scan_tickets", sql=f"SELECT {', '.join(TICKET_COLS)} FROM tickets")
def _scan_tickets(v):
    """IO1: declared-schema scan + derived tickets view."""
    return tickets_v(v)


@query("ticket_list", sql=f"""
SELECT {_TCOLS_SQL}, c.name AS customer_name, c.email AS customer_email, c.phone AS customer_phone,
       {_PRANK_SQL.format(p='t.')} AS priority_rank
FROM tickets t JOIN customers c ON c.id = t.customer_id""")
def _ticket_list(v):
    """P1 + J1 + S1."""
    return Q.ticket_list(tickets_v(v), v.customers)


@query("ticket_search", sql="""
SELECT t.id, t.subject, c.name AS customer_name, t.status
FROM tickets t JOIN customers c ON c.id = t.customer_id
WHERE contains(lower(CAST(t.id AS VARCHAR)), 'crash') OR contains(lower(t.subject), 'crash')
   OR contains(lower(c.name), 'crash') OR contains(lower(t.description), 'crash')""")
def _ticket_search(v):
    """Literal, case-insensitive substring over id, subject, customer name, description."""
    return Q.ticket_search(Q.ticket_list(tickets_v(v), v.customers), "crash") \
        .select("id", "subject", "customer_name", "status")


@query("ticket_filter", sql=f"""
SELECT id, status, priority, category FROM tickets
WHERE status = 'Open' AND {_UNCLASSIFIED_SQL.format(p='')} = 'Unclassified'""")
def _ticket_filter(v):
    """P3 + P4: status filter and the Unclassified category."""
    return Q.ticket_filter(tickets_v(v), status="Open", category="Unclassified") \
        .select("id", "status", "priority", "category")


@query("ticket_lookup", sql="""
SELECT t.id, t.subject, c.name AS customer_name, c.external_customer_id
FROM tickets t JOIN customers c ON c.id = t.customer_id
WHERE t.id IN (SELECT ticket_id FROM status_changes)""")
def _ticket_lookup(v):
    """P5: point lookups for a frame of requested ids."""
    return Q.lookup_tickets(tickets_v(v), v.customers, v.status_changes) \
        .select("id", "subject", "customer_name", "external_customer_id")


_TOOLS4 = "['get_customer', 'get_ticket', 'get_order_status', 'delete_customer']"


def tool_requests(v):
    ev = v.table("events")
    tool = F.element_at(F.array(*[F.lit(x) for x in ["get_customer", "get_ticket", "get_order_status",
                                                      "delete_customer"]]), (F.col("event_id") % 4 + 1).cast("int"))
    return ev.select(F.col("event_id").alias("request_id"), tool.alias("tool"),
                     F.when(tool == "get_customer", F.col("user_id") * 2).otherwise(F.col("event_id") * 2)
                     .alias("key"))


@query("tool_lookups", sql=f"""
WITH req AS (
  SELECT event_id AS request_id, {_TOOLS4}[event_id % 4 + 1] AS tool,
         CASE WHEN {_TOOLS4}[event_id % 4 + 1] = 'get_customer' THEN user_id * 2 ELSE event_id * 2 END AS key
  FROM events)
SELECT r.request_id, r.tool, r.key,
       CASE WHEN r.tool = 'get_customer' THEN c.id IS NOT NULL WHEN r.tool = 'get_ticket' THEN t.id IS NOT NULL
            ELSE FALSE END AS ok,
       c.name AS customer_name, c.external_customer_id, t.subject AS ticket_subject, t.status AS ticket_status,
       t.priority AS ticket_priority, t.category AS ticket_category,
       CASE WHEN r.tool = 'get_order_status' THEN '{LX.TOOL_ORDER_UNAVAILABLE}'
            WHEN r.tool NOT IN ('get_customer', 'get_ticket', 'get_order_status') THEN '{LX.TOOL_NOT_PERMITTED}'
       END AS error
FROM req r
LEFT JOIN customers c ON r.tool = 'get_customer' AND c.id = r.key
LEFT JOIN tickets t ON r.tool = 'get_ticket' AND t.id = r.key""")
def _tool_lookups(v):
    """Allow-listed lookups, one result row per request."""
    return Q.resolve_lookups(tool_requests(v), v.customers, tickets_v(v))


def _last_sql(direction_filter: str) -> str:
    return f"""(SELECT ticket_id, content, created_at FROM (
      SELECT ticket_id, content, created_at,
             row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS rn
      FROM messages {direction_filter}) WHERE rn = 1)"""


@query("inbox", sql=f"""
SELECT t.id AS ticket_id, t.channel, c.name AS customer_name, t.category, t.priority,
       CASE WHEN length(coalesce(l.content, t.description)) > 72
            THEN concat(substr(coalesce(l.content, t.description), 1, 72), '…')
            ELSE coalesce(l.content, t.description) END AS preview,
       l.created_at AS last_inbound_at
FROM tickets t LEFT JOIN {_last_sql("WHERE direction = 'inbound'")} l ON l.ticket_id = t.id
LEFT JOIN customers c ON c.id = t.customer_id
WHERE t.channel = 'Email' AND {_OPEN_SQL.format(p='t.')}""")
def _inbox(v):
    """P7 + P8 + W3: Email inbox, unread (open) tickets, latest inbound preview."""
    return Q.inbox(tickets_v(v), v.customers, v.messages, channel="Email", unread_only=True)


@query("inbox_internal", sql="""
SELECT id AS ticket_id, subject, status, channel FROM tickets
WHERE id IN (SELECT ticket_id FROM messages WHERE direction = 'outbound')""")
def _inbox_internal(v):
    """Tickets with an outbound reply (semi join)."""
    return Q.inbox_internal(tickets_v(v), v.messages)


@query("conversation_search", sql="""
SELECT t.id AS ticket_id, c.name AS customer_name, t.subject, t.channel
FROM tickets t JOIN customers c ON c.id = t.customer_id
WHERE contains(lower(concat(c.name, t.subject, t.description)), 'export') AND t.channel = 'Web'""")
def _conversation_search(v):
    """Search over name+subject+description, AND channel."""
    return Q.conversation_search(tickets_v(v), v.customers, "export", channel="Web")


@query("conversation_list", sql=f"""
SELECT t.id AS ticket_id, concat(substr(coalesce(l.content, t.description), 1, 48), '…') AS preview,
       strftime(t.created_at, '%Y-%m-%d %H:%M') AS created_minute
FROM tickets t LEFT JOIN {_last_sql('')} l ON l.ticket_id = t.id""")
def _conversation_list(v):
    """Latest message of either direction, 48 chars + ellipsis."""
    return Q.conversation_list(tickets_v(v), v.messages)


@query("conversation_tail", sql="""
SELECT ticket_id, message_id, direction, content, created_at,
       count(*) OVER (PARTITION BY ticket_id) - back + 1 AS position
FROM (SELECT ticket_id, id AS message_id, direction, content, created_at,
             row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS back
      FROM messages) WHERE back <= 8""")
def _conversation_tail(v):
    """Last 8 messages per ticket, oldest first."""
    return Q.conversation_tail(v.messages, 8)


@query("conversation_thread", sql="""
SELECT ticket_id, id AS message_id, direction, sender, content, created_at FROM messages""")
def _conversation_thread(v):
    """Full ordered thread."""
    return Q.conversation_thread(v.messages)


@query("customer_messages", sql="""
SELECT customer_id, ticket_id, id AS message_id, direction, channel, created_at FROM messages""")
def _customer_messages(v):
    """Messages ⋈ tickets per customer, newest first."""
    return Q.customer_messages(v.messages)


@query("top_issues", sql=f"""
SELECT id, subject, priority, status, created_at, row_number() OVER (ORDER BY {s1()}) AS rank
FROM tickets WHERE {_OPEN_SQL.format(p='')} QUALIFY rank <= 5""")
def _top_issues(v):
    """S2 + P12: first 5 open tickets (not Resolved/Closed) in S1 order."""
    return Q.top_tickets(tickets_v(v), 5, open_only=True)


@query("recent_activity", sql=f"""
SELECT id, subject, priority, status, created_at, row_number() OVER (ORDER BY {s1()}) AS rank
FROM tickets QUALIFY rank <= 5""")
def _recent_activity(v):
    """S3: "recent" activity, in S1 (priority-first) order."""
    return Q.top_tickets(tickets_v(v), 5)


@query("customer_recent", sql=f"""
SELECT customer_id, id, subject, priority, created_at,
       row_number() OVER (PARTITION BY customer_id ORDER BY {s1()}) AS rank
FROM tickets QUALIFY rank <= 5""")
def _customer_recent(v):
    """5 tickets per customer in S1 order."""
    return Q.customer_recent(tickets_v(v), 5)


@query("sentiment_sequence", sql=f"""
SELECT customer_id, id AS ticket_id, sentiment,
       row_number() OVER (PARTITION BY customer_id ORDER BY {s1()}) AS ticket_number
FROM tickets WHERE sentiment IS NOT NULL""")
def _sentiment_sequence(v):
    """Per-customer running number over tickets with a sentiment."""
    return Q.sentiment_sequence(tickets_v(v))


@query("feedback_recent", sql="""
SELECT *, row_number() OVER (ORDER BY created_at DESC, feedback_id DESC) AS rank FROM feedback QUALIFY rank <= 40""")
def _feedback_recent(v):
    """Latest 40 feedback rows."""
    return Q.feedback_recent(v.feedback, 40)


@query("feedback_split", sql="""
SELECT feedback_id, feedback_type,
       CASE WHEN contains(lower(feedback_type), 'feature') THEN 'feature'
            WHEN contains(lower(feedback_type), 'bug') THEN 'bug' ELSE 'other' END AS "group"
FROM feedback""")
def _feedback_split(v):
    """Feature / bug split by lower-case substring."""
    return Q.feedback_split(v.feedback)


@query("feedback_stars", sql="""
SELECT feedback_id, rating, concat(repeat('★', rating), repeat('☆', 5 - rating)) AS stars
FROM feedback WHERE rating IS NOT NULL""")
def _feedback_stars(v):
    """'★' × rating display string."""
    return Q.feedback_stars(v.feedback)


@query("doc_search", sql="""
SELECT doc_id, filename, document_type FROM knowledge WHERE contains(lower(filename), 'src3')""")
def _doc_search(v):
    """P10: knowledge file-name search."""
    return Q.doc_search(v.knowledge, "SRC3")


@query("category_list", sql=f"SELECT DISTINCT {_UNCLASSIFIED_SQL.format(p='')} AS category FROM tickets")
def _category_list(v):
    """Sorted distinct categories."""
    return M.category_list(v.tickets)


# ----------------------------------------------------------------------------- aggregates

@query("kpi_metrics", sql="""
SELECT * FROM
 (SELECT count(*) AS total, count_if(status IN ('Open', 'In Progress', 'Pending')) AS open,
         count_if(priority IN ('High', 'Urgent') AND status NOT IN ('Resolved', 'Closed')) AS high,
         count_if(status IN ('Resolved', 'Closed')) AS resolved,
         count_if(status = 'Escalated' OR severity = 'Critical') AS escalated_or_critical FROM tickets),
 (SELECT count(*) AS customers FROM customers),
 (SELECT count(*) AS messages FROM messages),
 (SELECT count_if(status = 'New') AS pending_feedback FROM feedback)""")
def _kpi_metrics(v):
    """A1 + P13: headline counters (KPI-open excludes Escalated)."""
    return M.kpi_metrics(v.tickets, v.customers, v.messages, v.feedback)


@query("brief_counts", sql=f"""
SELECT count_if(CAST(created_at AS DATE) = DATE '{BRIEF_AS_OF[:10]}') AS tickets_today,
       count_if({_OPEN_SQL.format(p='')}) AS open,
       count_if({_OPEN_SQL.format(p='')} AND priority IN ('High', 'Urgent')) AS high_priority,
       count_if(status = 'Escalated') AS escalated
FROM tickets""")
def _brief_counts(v):
    """A2: daily brief counters at an explicit as_of."""
    return M.brief_counts(v.tickets, BRIEF_AS_OF)


@query("brief_categories", sql=f"""
SELECT {_UNCLASSIFIED_SQL.format(p='')} AS category, count(*) AS tickets FROM tickets GROUP BY 1""")
def _brief_categories(v):
    """A3: category counts, most common first."""
    return M.category_counts(v.tickets)


@query("quality_signal", sql="""
SELECT count(*) AS analyses, CASE WHEN count(*) > 0 THEN avg(coalesce(confidence, 0.0)) END AS average_confidence,
       count_if(NOT validation_passed) AS validation_failures,
       CASE WHEN count(*) > 0 THEN count_if(rag_evidence_available) / count(*) END AS rag_evidence_rate,
       count_if(mcp_used AND NOT mcp_succeeded) AS mcp_failures
FROM quality""", floats=["average_confidence", "rag_evidence_rate"])
def _quality_signal(v):
    """A4: quality signal of the brief."""
    return M.quality_signal(v.quality)


@query("value_counts", sql="""
SELECT dimension, value, count(*) AS tickets FROM (
  SELECT 'category' AS dimension, coalesce(nullif(category, ''), 'Unclassified') AS value FROM tickets
  UNION ALL SELECT 'priority', priority FROM tickets
  UNION ALL SELECT 'sentiment', coalesce(sentiment, 'Not analyzed') FROM tickets
  UNION ALL SELECT 'channel', channel FROM tickets)
WHERE value IS NOT NULL GROUP BY dimension, value""")
def _value_counts(v):
    """A5: category / priority / sentiment / channel counts in one pass."""
    return M.value_counts(v.tickets)


@query("analytics_tiles", sql="""
SELECT count(*) AS tickets, count_if(status IN ('Open', 'In Progress', 'Pending')) AS open,
       count_if(status = 'Escalated') AS escalated, count(DISTINCT channel) AS channels FROM tickets""")
def _analytics_tiles(v):
    """Analytics tiles."""
    return M.analytics_tiles(v.tickets)


@query("daily_volume", sql="SELECT CAST(created_at AS DATE) AS day, count(*) AS tickets FROM tickets GROUP BY 1")
def _daily_volume(v):
    """Tickets per UTC day."""
    return M.daily_volume(v.tickets)


@query("volume_trend", sql=f"""
WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '{AS_OF[:10]}' - INTERVAL 6 DAY,
                                                        DATE '{AS_OF[:10]}' + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d)),
series AS (SELECT unnest(['Open tickets', 'Resolved', 'Escalated']) AS series),
counts AS (
  SELECT CAST(created_at AS DATE) AS day,
         CASE WHEN status IN ('Open', 'In Progress', 'Pending') THEN 'Open tickets'
              WHEN status IN ('Resolved', 'Closed') THEN 'Resolved' WHEN status = 'Escalated' THEN 'Escalated' END
           AS series, count(*) AS tickets
  FROM tickets GROUP BY 1, 2)
SELECT d.day, s.series, CAST(coalesce(c.tickets, 0) AS BIGINT) AS tickets
FROM days d CROSS JOIN series s LEFT JOIN counts c ON c.day = d.day AND c.series = s.series""")
def _volume_trend(v):
    """7-day × 3-series zero-filled trend."""
    return M.volume_trend(v.tickets, AS_OF)


@query("customer_360", sql="""
SELECT c.id AS customer_id, c.name, CAST(coalesce(a.total, 0) AS BIGINT) AS total,
       CAST(coalesce(a.open, 0) AS BIGINT) AS open, CAST(coalesce(a.resolved, 0) AS BIGINT) AS resolved,
       CAST(coalesce(a.escalated, 0) AS BIGINT) AS escalated
FROM customers c LEFT JOIN (
  SELECT customer_id, count(*) AS total, count_if(status NOT IN ('Resolved', 'Closed')) AS open,
         count_if(status IN ('Resolved', 'Closed')) AS resolved, count_if(status = 'Escalated') AS escalated
  FROM tickets GROUP BY customer_id) a ON a.customer_id = c.id""")
def _customer_360(v):
    """Per-customer ticket counts."""
    return M.customer_360(v.customers, v.tickets)


@query("customer_channels", sql="""
SELECT customer_id, array_to_string(list_sort(list(DISTINCT channel)), ', ') AS channels
FROM tickets GROUP BY customer_id""")
def _customer_channels(v):
    """Sorted distinct channel set per customer."""
    return M.customer_channels(v.tickets)


@query("ticket_context", sql="""
SELECT id AS ticket_id, customer_id, count(*) OVER (PARTITION BY customer_id) AS customer_tickets FROM tickets""")
def _ticket_context(v):
    """Ticket count of the ticket's customer."""
    return M.ticket_context(v.tickets)


@query("quality_kpis", sql="""
SELECT q.*, a.approved_tickets, a.approved_tickets / greatest(1, q.analyzed_tickets) AS acceptance_rate
FROM (SELECT count(*) AS analyses, count(DISTINCT ticket_id) AS analyzed_tickets,
             avg(coalesce(confidence, 0.0)) AS avg_confidence, avg(CAST(human_edited AS INTEGER)) AS edit_rate,
             avg(CAST(NOT validation_passed AS INTEGER)) AS failure_rate,
             avg(CAST(regenerated AS INTEGER)) AS regenerated_rate,
             CAST(sum(CAST(human_edited AS INTEGER)) AS BIGINT) AS human_edits,
             count_if(NOT validation_passed) AS validation_failures,
             CAST(sum(CAST(regenerated AS INTEGER)) AS BIGINT) AS regenerated FROM quality) q,
     (SELECT count(DISTINCT ticket_id) AS approved_tickets FROM messages
      WHERE direction = 'outbound' AND delivery_status = 'demo_sent') a""",
       floats=["avg_confidence", "edit_rate", "failure_rate", "regenerated_rate", "acceptance_rate"])
def _quality_kpis(v):
    """A15 + A16: acceptance and quality rates."""
    return M.quality_kpis(v.quality, v.messages)


@query("quality_trend", sql="""
SELECT CAST(created_at AS DATE) AS day, avg(CAST(validation_passed AS INTEGER)) * 100 AS acceptance
FROM quality GROUP BY 1""", floats=["acceptance"])
def _quality_trend(v):
    """Daily validation pass rate × 100."""
    return M.quality_trend(v.quality)


@query("confidence_hist", sql="""
WITH labels AS (SELECT * FROM (VALUES ('0–50%', 0), ('50–70%', 1), ('70–90%', 2), ('90–100%', 3)) l(bucket, bucket_order)),
b AS (SELECT CASE WHEN c >= 0 AND c <= 0.5 THEN '0–50%' WHEN c > 0.5 AND c <= 0.7 THEN '50–70%'
                  WHEN c > 0.7 AND c <= 0.9 THEN '70–90%' WHEN c > 0.9 AND c <= 1.0001 THEN '90–100%' END AS bucket
      FROM (SELECT coalesce(confidence, 0.0) AS c FROM quality))
SELECT l.bucket, CAST(l.bucket_order AS BIGINT) AS bucket_order, CAST(coalesce(n.analyses, 0) AS BIGINT) AS analyses
FROM labels l LEFT JOIN (SELECT bucket, count(*) AS analyses FROM b WHERE bucket IS NOT NULL GROUP BY 1) n
  ON n.bucket = l.bucket""")
def _confidence_hist(v):
    """Right-closed confidence histogram with zero bins."""
    return M.confidence_hist(v.quality)


@query("quality_by_category", sql=f"""
SELECT {_UNCLASSIFIED_SQL.format(p='t.')} AS category, avg(coalesce(q.confidence, 0.0)) AS confidence,
       avg(CAST(q.human_edited AS INTEGER)) AS edit_rate
FROM quality q LEFT JOIN tickets t ON t.id = q.ticket_id GROUP BY 1""", floats=["confidence", "edit_rate"])
def _quality_by_category(v):
    """A20 + J7: per-category confidence and edit rate."""
    return M.quality_by_category(v.quality, v.tickets)


@query("csat", sql="SELECT avg(rating) AS csat, count(rating) AS ratings FROM feedback", floats=["csat"])
def _csat(v):
    """CSAT = mean rating."""
    return M.csat(v.feedback)


# ----------------------------------------------------------------------------- SLA

@query("sla_state", sql=SLA_STATE_SQL)
def _sla_state(v):
    """SLA1 + J2: both clocks at as_of."""
    return sla_states(v)


@query("sla_assign", sql="""
WITH p AS (SELECT id, first_response_minutes, resolution_minutes FROM sla_policies WHERE active
           ORDER BY created_at, id LIMIT 1)
SELECT t.id AS ticket_id, p.id AS policy_id, t.created_at + to_minutes(p.first_response_minutes) AS first_response_due_at,
       t.created_at + to_minutes(p.resolution_minutes) AS resolution_due_at,
       'on_track' AS first_response_status, 'on_track' AS resolution_status
FROM tickets t, p""")
def _sla_assign(v):
    """SLA2 + W11: due times from the oldest active policy."""
    return SLA.sla_assign(v.tickets, v.sla_policies)


@query("sla_assessment", sql=f"""
SELECT t.id AS ticket_id, s.ticket_id IS NOT NULL AS configured,
       CASE WHEN s.ticket_id IS NOT NULL THEN coalesce(s.first_response_status, 'on_track') ELSE 'not_configured' END
         AS first_response_status,
       CASE WHEN s.ticket_id IS NOT NULL
            THEN {_clock_sql('s.resolution_due_at', 21600, "t.status IN ('Resolved', 'Closed')")}
            ELSE 'not_configured' END AS resolution_status,
       s.resolution_due_at,
       date_diff('microsecond', {_AS_OF_SQL}, s.resolution_due_at) / 1000000.0 AS remaining_seconds
FROM tickets t LEFT JOIN ticket_sla s ON s.ticket_id = t.id""", floats=["remaining_seconds"])
def _sla_assessment(v):
    """SLA3: workflow SLA assessment."""
    return SLA.sla_assessment(v.tickets, v.ticket_sla, AS_OF)


@query("sla_dashboard", sql=f"""
WITH st AS ({SLA_STATE_SQL})
SELECT s.*, t.resolved, t.total, s.sla_met / greatest(1, s.sla_rows) AS met_rate, t.resolved / greatest(1, t.total) AS resolution_rate
FROM (SELECT count_if(first_response_status IN ('at_risk', 'breached') OR resolution_status IN ('at_risk', 'breached'))
               AS sla_risks,
             count_if(first_response_status IN ('met', 'on_track') AND resolution_status IN ('met', 'on_track'))
               AS sla_met,
             count(*) AS sla_rows FROM st) s,
     (SELECT count_if(status IN ('Resolved', 'Closed')) AS resolved, count(*) AS total FROM tickets) t""",
       floats=["met_rate", "resolution_rate"])
def _sla_dashboard(v):
    """SLA dashboard numbers."""
    return SLA.sla_dashboard(sla_states(v), v.tickets)


_HEALTH_SQL = """CASE WHEN first_response_status = 'breached' OR resolution_status = 'breached' THEN 'Breached'
       WHEN first_response_status = 'at_risk' OR resolution_status = 'at_risk' THEN 'At Risk' ELSE 'On Time' END"""


@query("sla_health", sql=f"""
WITH st AS ({SLA_STATE_SQL}),
b AS (SELECT {_HEALTH_SQL} AS bucket FROM st),
labels AS (SELECT * FROM (VALUES ('On Time', 0), ('At Risk', 1), ('Breached', 2)) l(bucket, bucket_order))
SELECT l.bucket, CAST(l.bucket_order AS BIGINT) AS bucket_order, CAST(coalesce(n.tickets, 0) AS BIGINT) AS tickets,
       coalesce(n.tickets, 0) / greatest(1, (SELECT count(*) FROM b)) AS share
FROM labels l LEFT JOIN (SELECT bucket, count(*) AS tickets FROM b GROUP BY 1) n ON n.bucket = l.bucket""",
       floats=["share"])
def _sla_health(v):
    """A10: SLA health buckets and shares."""
    return SLA.sla_health(sla_states(v))


@query("sla_risks", sql=f"""
WITH st AS ({SLA_STATE_SQL})
SELECT t.id AS ticket_id, t.subject, st.resolution_status, st.resolution_due_at
FROM tickets t JOIN st ON st.ticket_id = t.id
WHERE {_OPEN_SQL.format(p='t.')} AND st.resolution_status IN ('at_risk', 'breached')""")
def _sla_risks(v):
    """A11 + J5: open tickets at risk of / past the resolution target."""
    return SLA.sla_risks(v.tickets, sla_states(v))


# ----------------------------------------------------------------------------- classification

def _contains_any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(x, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def classify_sql(subject: str, message: str, source: str, keep: str) -> str:
    """CL1 in DuckDB SQL (same rule tables)."""
    cat = "CASE " + " ".join(f"WHEN {_contains_any_sql(ws)} THEN '{c}'" for c, _, ws in LX.CATEGORY_RULES) + \
          f" ELSE '{LX.DEFAULT_CATEGORY[0]}' END"
    intent = "CASE " + " ".join(f"WHEN {_contains_any_sql(ws)} THEN '{i}'" for _, i, ws in LX.CATEGORY_RULES) + \
             f" ELSE '{LX.DEFAULT_CATEGORY[1]}' END"
    urgent = _contains_any_sql(LX.URGENT_KEYWORDS)
    neg = _contains_any_sql(LX.NEGATIVE_KEYWORDS)
    return f"""
SELECT {keep}, category, intent AS subcategory, intent,
       CASE WHEN urgent THEN 'Urgent' WHEN neg AND category = 'Billing' THEN 'High' WHEN neg THEN 'Medium'
            ELSE 'Low' END AS priority,
       CASE WHEN urgent THEN 'Critical' WHEN neg THEN 'Major' ELSE 'Minor' END AS severity,
       CASE WHEN neg THEN 'Negative' ELSE 'Neutral' END AS sentiment,
       CASE WHEN neg THEN '{LX.IMPACT_NEGATIVE}' ELSE '{LX.IMPACT_NEUTRAL}' END AS customer_impact,
       list_filter([CASE WHEN category = 'Billing' AND NOT regexp_matches(x, '{LX.AMOUNT_PATTERN}')
                         THEN '{LX.MISSING_AMOUNT}' END,
                    CASE WHEN contains(x, 'payment') AND NOT contains(x, 'reference')
                         THEN '{LX.MISSING_REFERENCE}' END], lambda e: e IS NOT NULL) AS missing_information,
       CASE WHEN urgent THEN '{LX.REASON_URGENT}' WHEN neg THEN '{LX.REASON_NEGATIVE}'
            ELSE '{LX.REASON_NONE}' END AS urgency_reason,
       CASE WHEN category <> '{LX.DEFAULT_CATEGORY[0]}' THEN {LX.CONFIDENCE_KNOWN} ELSE {LX.CONFIDENCE_GENERAL} END
         AS confidence
FROM (SELECT *, {cat} AS category, {intent} AS intent, {urgent} AS urgent, {neg} AS neg
      FROM (SELECT {keep}, lower(concat(coalesce({subject}, ''), ' ', coalesce({message}, ''))) AS x
            FROM {source}))"""


CLASSIFY_COLS = ["category", "subcategory", "intent", "priority", "severity", "sentiment", "customer_impact",
                 "urgency_reason", "confidence"]


@query("classify", sql=f"""
SELECT id AS ticket_id, {', '.join(CLASSIFY_COLS)}, array_to_string(missing_information, '; ') AS missing_info
FROM ({classify_sql('subject', 'description', 'tickets', 'id')})""", floats=["confidence"])
def _classify(v):
    """CL1: rule classification of every ticket."""
    c = CL.classify(v.tickets, keep=["id"])
    return c.select(F.col("id").alias("ticket_id"), *CLASSIFY_COLS,
                    F.array_join("missing_information", "; ").alias("missing_info"))


@query("low_confidence", sql=f"""
SELECT id AS ticket_id, confidence, confidence < {LX.LOW_CONFIDENCE} AS low_confidence
FROM ({classify_sql('subject', 'description', 'tickets', 'id')})""", floats=["confidence"])
def _low_confidence(v):
    """CL15: low-confidence flag over the rule analysis."""
    c = CL.classify(v.tickets, keep=["id"])
    return c.select(F.col("id").alias("ticket_id"), "confidence",
                    CL.low_confidence(F.col("confidence")).alias("low_confidence"))


@query("sla_health_by_category", sql=f"""
WITH st AS ({SLA_STATE_SQL}),
cl AS ({classify_sql('subject', 'description', 'tickets', 'id')}),
b AS (SELECT cl.category, {_HEALTH_SQL} AS bucket FROM st JOIN cl ON cl.id = st.ticket_id),
grid AS (SELECT g.category, l.bucket, l.bucket_order FROM (SELECT DISTINCT category FROM b) g,
         (VALUES ('On Time', 0), ('At Risk', 1), ('Breached', 2)) l(bucket, bucket_order))
SELECT g.category, g.bucket, CAST(g.bucket_order AS BIGINT) AS bucket_order,
       CAST(coalesce(n.tickets, 0) AS BIGINT) AS tickets,
       coalesce(n.tickets, 0) / greatest(1, tot.sla_rows) AS share
FROM grid g LEFT JOIN (SELECT category, bucket, count(*) AS tickets FROM b GROUP BY 1, 2) n
  ON n.category = g.category AND n.bucket = g.bucket
LEFT JOIN (SELECT category, count(*) AS sla_rows FROM b GROUP BY 1) tot ON tot.category = g.category""",
       floats=["share"])
def _sla_health_by_category(v):
    """Flagship slice: tickets → CL1 category → SLA1 → A10 health buckets per category."""
    cat = CL.classify(v.tickets, keep=["id"]).select(F.col("id").alias("ticket_id"), "category")
    states = sla_states(v).join(cat, "ticket_id", "inner")
    return SLA.sla_health(states, by=["category"])


@query("brief_facts", sql=f"""
WITH st AS ({SLA_STATE_SQL}),
r AS (SELECT count(*) AS risk_count FROM tickets t JOIN st ON st.ticket_id = t.id
      WHERE {_OPEN_SQL.format(p='t.')} AND st.resolution_status IN ('at_risk', 'breached')),
q AS (SELECT count(*) AS analyses, count_if(NOT validation_passed) AS failures FROM quality),
c AS (SELECT {_UNCLASSIFIED_SQL.format(p='')} AS category, count(*) AS n FROM tickets GROUP BY 1),
top AS (SELECT arg_min(category, (-n, category)) AS top_category FROM c)
SELECT r.risk_count, q.analyses, q.failures, top.top_category,
       format('{{:d}} ticket(s) are at risk or past an SLA target.', r.risk_count) AS risk_text,
       format('{{:d}} ticket analysis record(s) are available.', q.analyses) AS analysis_text,
       format('{{:d}} recent response validation failure(s).', q.failures) AS failure_text,
       CASE WHEN top.top_category IS NOT NULL THEN format('Most common ticket category: {{}}.', top.top_category)
       END AS category_text
FROM r, q, top""")
def _brief_facts(v):
    """Narrative facts of the brief."""
    risks = SLA.sla_risks(v.tickets, sla_states(v))
    return M.brief_facts(risks, v.quality, M.category_counts(v.tickets))
