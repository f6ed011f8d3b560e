"""DuckDB definitions of the derived views (mirror of ``sources.views``).

``with_views(sql)`` prepends, as CTEs, exactly the views a statement references
(transitively), so every oracle statement runs on the raw pre-registered tables.
"""

from __future__ import annotations

import re

from opsdesk.sources.views import (DRAFT_TEXTS, FEEDBACK_TYPES, PHRASES, POLICIES, PREDICTION_TEXTS,
                                   STATUS_CYCLE)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_PHRASE_ROWS = ", ".join(f"({p}, {_q(s)}, {_q(m)}, {_q(c)}, {_q(se)})" for p, s, m, c, se in PHRASES)
_POLICY_ROWS = ", ".join(
    f"({i}::BIGINT, {_q(n)}, {fr}::INTEGER, {rm}::INTEGER, {str(a).upper()}, TIMESTAMP {_q(ts)})"
    for i, n, fr, rm, a, ts in POLICIES)

VIEWS: dict[str, str] = {
    "phrases": f"SELECT * FROM (VALUES {_PHRASE_ROWS}) AS p(pid, subject, message, category, sentiment)",
    "tickets": """
SELECT e.event_id AS id, e.user_id AS customer_id, p.subject,
       concat(p.message, '. ', b.text) AS description,
       CASE e.event_id % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'SMS' ELSE 'Web' END AS channel,
       CASE WHEN e.k % 20 = 0 THEN 'Escalated' WHEN e.k % 20 = 1 THEN 'Pending'
            WHEN e.k % 20 = 2 THEN 'In Progress' WHEN e.k % 20 = 3 THEN 'Closed'
            WHEN e.k % 3 = 0 THEN 'Open' ELSE 'Resolved' END AS status,
       CASE WHEN e.k % 11 = 0 THEN NULL ELSE p.category END AS category,
       CASE WHEN e.k % 10 = 0 THEN 'Urgent' WHEN e.k % 10 IN (1, 2) THEN 'High'
            WHEN e.k % 10 IN (3, 4, 5) THEN 'Medium' ELSE 'Low' END AS priority,
       CASE WHEN e.k % 10 = 0 THEN 'Critical' WHEN e.k % 10 IN (1, 2) THEN 'Major'
            WHEN e.k % 10 IN (3, 4, 5) THEN 'Moderate' ELSE 'Minor' END AS severity,
       CASE WHEN e.k % 7 = 0 THEN NULL ELSE p.sentiment END AS sentiment,
       e.ts AS created_at, e.k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
JOIN phrases p ON e.event_id % 12 = p.pid
LEFT JOIN benchmark b ON e.event_id % (SELECT greatest(1, max(item_id) + 1) FROM benchmark) = b.item_id""",
    "customers": """
SELECT c_custkey AS id, concat('EXT-', CAST(c_custkey AS VARCHAR)) AS external_customer_id, c_name AS name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('user', CAST(c_custkey AS VARCHAR), '@example.test') END AS email,
       concat('+1555', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS phone
FROM customer""",
    "messages": """
SELECT c.conv_id * 10 + c.turn AS id, c.conv_id AS ticket_id, t.customer_id, t.channel,
       CASE WHEN c.role = 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction,
       CASE WHEN c.role = 'assistant' THEN 'agent' ELSE 'customer' END AS sender,
       c.text AS content,
       CASE WHEN c.role = 'assistant' THEN 'demo_sent' ELSE 'received' END AS delivery_status,
       t.created_at + to_minutes(c.turn * 37) AS created_at
FROM conversations c JOIN tickets t ON c.conv_id = t.id
WHERE c.role <> 'system'""",
    "ticket_sla": """
SELECT id AS ticket_id, 2::BIGINT AS policy_id,
       CASE WHEN k % 13 = 0 THEN NULL ELSE created_at + to_minutes(60) END AS first_response_due_at,
       created_at + to_minutes(1440 * (1 + k % 40)) AS resolution_due_at,
       'on_track' AS first_response_status, 'on_track' AS resolution_status
FROM tickets WHERE id % 10 <> 0""",
    "sla_policies": f"SELECT * FROM (VALUES {_POLICY_ROWS}) AS p(id, name, first_response_minutes, "
                    "resolution_minutes, active, created_at)",
    "audit_events": """
SELECT event_id AS id,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 = 0 THEN NULL ELSE event_id END AS ticket_id,
       event_type, 'system' AS actor_type, concat('Recorded ', event_type, ' event.') AS description,
       ts AS created_at
FROM events""",
    "knowledge": """
SELECT doc_id, concat(source, '/', CAST(doc_id AS VARCHAR), '.txt') AS filename, lang AS document_type, text,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS uploaded_at,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id + 5) END AS indexed_at
FROM documents""",
    "queries": "SELECT item_id AS qid, text FROM benchmark",
    "quality": """
SELECT l.doc_id AS id, l.doc_id AS ticket_id, l.doc_id AS analysis_id,
       CASE WHEN l.doc_id % 17 = 0 THEN NULL ELSE CAST(l.doc_id % 101 AS DOUBLE) / 100.0 END AS confidence,
       l.quality = 1 AS validation_passed, l.toxic = 1 AS human_edited, l.doc_id % 7 = 0 AS regenerated,
       l.doc_id % 5 <> 0 AS rag_evidence_available, l.doc_id % 3 = 0 AS mcp_used,
       (l.doc_id % 3 = 0 AND l.doc_id % 2 = 0) AS mcp_succeeded, t.created_at
FROM labels l JOIN tickets t ON l.doc_id = t.id""",
    "feedback": f"""
SELECT event_id AS feedback_id, concat('user', CAST(user_id AS VARCHAR)) AS name,
       concat('user', CAST(user_id AS VARCHAR), '@example.test') AS email,
       CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 END AS rating,
       {_list(FEEDBACK_TYPES)}[k % 3 + 1] AS feedback_type,
       concat('Signup feedback ', CAST(event_id AS VARCHAR)) AS message,
       CASE WHEN k % 4 <> 0 THEN 'New' ELSE 'Reviewed' END AS status, ts AS created_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup')""",
    "requests": """
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'bad@@x'
            ELSE concat('user', CAST(c_custkey % 50 AS VARCHAR), '@new.test') END AS email,
       p.subject, p.message AS description,
       CASE c_custkey % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'SMS' ELSE 'Web' END AS channel,
       concat('+1555', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS phone,
       TIMESTAMP '2024-01-15 00:00:00' + to_seconds(c_custkey) AS requested_at
FROM customer JOIN phrases p ON c_custkey % 12 = p.pid""",
    "drafts": f"""
SELECT t.id * 10 + s.seq AS draft_id, t.id AS ticket_id, s.seq AS review_round,
       {_list(DRAFT_TEXTS)}[t.id % 5 + 1] AS content,
       t.channel, 'Support update' AS subject, t.id % 6 <> 0 AS agent_approved,
       t.created_at + to_hours(s.seq + 1) AS created_at
FROM tickets t, LATERAL (SELECT unnest(range(1, CASE WHEN t.id % 5 = 4 THEN 2 ELSE 1 END + 1)) AS seq) s""",
    "predictions": f"""
SELECT id AS ticket_id, {_list(PREDICTION_TEXTS)}[(id // 3) % 6 + 1] AS raw_json
FROM tickets WHERE id % 3 = 0""",
    "status_changes": f"""
SELECT e.event_id * 10 + s.seq AS change_id, e.event_id AS ticket_id,
       {_list(STATUS_CYCLE)}[(e.k + 3 * (s.seq - 1)) % 7 + 1] AS status,
       e.ts + to_days(CAST(s.seq AS INTEGER)) AS changed_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click') e,
     LATERAL (SELECT unnest(range(1, CASE WHEN e.event_id % 5 = 0 THEN 2 ELSE 1 END + 1)) AS seq) s""",
    "analyses": """
SELECT id AS analysis_id, ticket_id, content AS draft, created_at FROM messages WHERE direction = 'outbound'""",
}

_ORDER = list(VIEWS)


def _refs(sql: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every view it (transitively) references."""
    needed: set[str] = set()
    frontier = _refs(sql)
    while frontier:
        name = frontier.pop()
        if name in needed:
            continue
        needed.add(name)
        frontier |= _refs(VIEWS[name]) - {name}
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ORDER if name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
