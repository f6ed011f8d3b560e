"""Catalogue, part 3: enrichment workflow, resolution rules, routing, stored analyses, timeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import classify as CL
from opsdesk.operators import resolve as RS
from opsdesk.operators import state as ST
from opsdesk.plans import workflow as WF
from opsdesk.plans.catalog_ops import _clock_sql, classify_sql
from opsdesk.plans.catalog_text import CHUNKS_SQL, CVEC_SQL, SIM_SQL, vectors_sql
from opsdesk.plans.knowledge import knowledge_index
from opsdesk.plans.registry import query
from opsdesk.session import scratch_path
from opsdesk.sources.views import AS_OF


def sql_text(s: str) -> str:
    """A Python string as a DuckDB expression (quotes doubled, newlines as chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{LX.WHITESPACE}+', ''), '{LX.WHITESPACE}+$', '')"


def _in_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TEAM_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in LX.TEAM_BY_CATEGORY.items()) + \
            f" ELSE '{LX.DEFAULT_TEAM}' END"
_REFUND_SQL = " OR ".join(f"contains(lower(description), '{w}')" for w in LX.UNSAFE_REFUND_KEYWORDS)

ENRICH_CTES = f"""
chunks AS ({CHUNKS_SQL}),
cv AS ({CVEC_SQL}),
tt AS (SELECT id, customer_id, channel, description,
              concat(coalesce(subject, ''), ' ', coalesce(description, '')) AS text,
              sha256(concat(coalesce(subject, ''), ' ', coalesce(description, ''))) AS th FROM tickets),
texts AS (SELECT DISTINCT th, text FROM tt WHERE length(trim(text)) > 0),
qv AS ({vectors_sql("texts", "th", "text")}),
qpairs AS (SELECT q.th, c.doc_id, c.chunk_index, sum(q.v * c.v) / sqrt(CAST(q.norm2 * c.norm2 AS DOUBLE)) AS cosine
           FROM qv q JOIN cv c ON q.bucket = c.bucket GROUP BY q.th, c.doc_id, c.chunk_index, q.norm2, c.norm2),
qbest AS (SELECT *, row_number() OVER (PARTITION BY th ORDER BY cosine DESC, doc_id, chunk_index) AS rank
          FROM qpairs QUALIFY rank <= {LX.K_WORKFLOW}),
ev AS (SELECT b.th, count(*) AS evidence_count, list(ch.content ORDER BY b.rank) AS contents,
              list(k.filename ORDER BY b.rank) AS sources
       FROM qbest b JOIN chunks ch ON ch.doc_id = b.doc_id AND ch.chunk_index = b.chunk_index
       JOIN knowledge k ON k.doc_id = b.doc_id GROUP BY b.th),
{SIM_SQL},
simc AS (SELECT ticket_id, count(*) AS similar_count FROM top8 GROUP BY 1),
slaa AS (SELECT tk.id AS ticket_id,
                CASE WHEN s.ticket_id IS NOT NULL
                     THEN {_clock_sql('s.resolution_due_at', 21600, "tk.status IN ('Resolved', 'Closed')")}
                     ELSE 'not_configured' END AS sla_resolution_status
         FROM tickets tk LEFT JOIN ticket_sla s ON s.ticket_id = tk.id),
cl AS ({classify_sql('subject', 'description', 'tickets', 'id')}),
e0 AS (SELECT tt.id AS ticket_id, tt.customer_id, tt.channel, tt.description, cl.category, cl.intent, cl.priority,
              cl.severity, cl.sentiment, cl.customer_impact, cl.confidence, cl.missing_information,
              coalesce(ev.evidence_count, 0) AS evidence_count, coalesce(ev.contents, []) AS contents,
              ev.sources, coalesce(simc.similar_count, 0) AS similar_count,
              coalesce(dupc.duplicate_count, 0) AS duplicate_count, slaa.sla_resolution_status,
              cl.category IN ({_in_list(LX.TOOL_CATEGORIES)}) AS mcp_used,
              cl.category IN ({_in_list(LX.TOOL_CATEGORIES)}) AND cu.id IS NOT NULL AS mcp_succeeded
       FROM tt JOIN cl ON cl.id = tt.id LEFT JOIN ev ON ev.th = tt.th LEFT JOIN simc ON simc.ticket_id = tt.id
       LEFT JOIN dupc ON dupc.ticket_id = tt.id LEFT JOIN slaa ON slaa.ticket_id = tt.id
       LEFT JOIN customers cu ON cu.id = tt.customer_id),
e1 AS (SELECT *, evidence_count > 0 AS has_ev FROM e0),
enr AS (
  SELECT ticket_id, 'rules' AS mode, category, intent, priority, severity, sentiment, customer_impact, confidence,
         CAST(evidence_count AS BIGINT) AS evidence_count, sources[1] AS top_source,
         CAST(similar_count AS BIGINT) AS similar_count, CAST(duplicate_count AS BIGINT) AS duplicate_count,
         sla_resolution_status, mcp_used, mcp_succeeded,
         CASE WHEN has_ev THEN concat({sql_text(LX.EVIDENCE_PREFIX)},
                                      array_to_string(list_transform(contents, lambda c: substr(c, 1, 220)), '; '))
              ELSE {sql_text(LX.NO_EVIDENCE_TEXT)} END AS investigation,
         concat(intent, ': ', substr(description, 1, 140)) AS problem_summary,
         array_to_string(list_filter([{sql_text(LX.STEP_CONFIRM)},
              CASE WHEN len(missing_information) > 0
                   THEN concat({sql_text(LX.STEP_MISSING_PREFIX)}, array_to_string(missing_information, ', '), '.') END,
              CASE WHEN has_ev THEN {sql_text(LX.STEP_WITH_EVIDENCE)} ELSE {sql_text(LX.STEP_WITHOUT_EVIDENCE)} END],
              lambda x: x IS NOT NULL), ' | ') AS recommended_steps,
         (severity = 'Critical' OR (NOT has_ev AND category = 'Billing')
          OR coalesce(sla_resolution_status = 'breached', FALSE)) AS escalation_required,
         CASE WHEN channel = 'SMS' THEN {sql_text(LX.DRAFT_SMS)}
              ELSE concat({sql_text(LX.DRAFT_GREETING)}, {_strip_sql('substr(description, 1, 360)')}, chr(10), chr(10),
                          coalesce(substr(contents[1], 1, 350), {sql_text(LX.DRAFT_NO_EVIDENCE)}),
                          {sql_text(LX.DRAFT_FOOTER)}) END AS draft,
         has_ev OR NOT ({_REFUND_SQL}) AS safe,
         {_TEAM_SQL} AS team,
         format('Routed based on {{}} category and ticket context.', category) AS routing_reason
  FROM e1)"""

ESC_REASON_SQL = (f"CASE WHEN escalation_required THEN {sql_text(LX.ESCALATE_REASON)} "
                  f"ELSE {sql_text(LX.NO_ESCALATE_REASON)} END")


def enriched(v):
    return WF.enrich_tickets(v.tickets, v.customers, knowledge_index(v), v.ticket_sla, AS_OF)


def enrich_flat(e):
    return e.select(
        "ticket_id", "mode", "category", "intent", "priority", "severity", "sentiment", "confidence",
        F.col("evidence_count").cast("bigint").alias("evidence_count"),
        F.try_element_at("evidence", F.lit(1))["source"].alias("top_source"),
        "similar_count", "duplicate_count", "sla_resolution_status", "mcp_used", "mcp_succeeded",
        "escalation_required", F.col("routing.team").alias("team"), "safe", "investigation",
        F.array_join("recommended_steps", " | ").alias("recommended_steps"), "draft")


@query("enrich", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, mode, category, intent, priority, severity, sentiment, confidence, evidence_count, top_source,
       similar_count, duplicate_count, sla_resolution_status, mcp_used, mcp_succeeded, escalation_required, team,
       safe, investigation, recommended_steps, draft FROM enr""", floats=["confidence"])
def _enrich(v):
    """CL12: full ticket enrichment of every ticket (rules mode)."""
    return enrich_flat(enriched(v))


_ENRICHED: dict[tuple, str] = {}


def enriched_once(v):
    """The enrichment, written once per application and data folder for all outputs made from it: a row
    per ticket and, apart, the evidence per text."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir.rstrip("/"))
    if key not in _ENRICHED:
        path = scratch_path(v.spark, f"enriched-{uuid.uuid4().hex}")
        rows, evidence = WF.enrich_parts(v.tickets, v.customers, knowledge_index(v), v.ticket_sla, AS_OF)
        rows.write.parquet(f"{path}/rows")
        evidence.write.parquet(f"{path}/evidence")
        _ENRICHED[key] = path
    return WF.with_evidence(*(v.spark.read.parquet(f"{_ENRICHED[key]}/{part}") for part in ("rows", "evidence")))


def _outputs(v):
    return WF.split_outputs(enriched_once(v), v.analyses, AS_OF)


@query("wf_recommendations", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, problem_summary, {sql_text(LX.LIKELY_CAUSE)} AS likely_cause, recommended_steps,
       {sql_text(" | ".join(LX.REQUIRED_CHECKS))} AS required_checks, {sql_text(LX.CUSTOMER_ACTION)} AS customer_action,
       {sql_text(LX.INTERNAL_ACTION)} AS internal_action,
       escalation_required, {ESC_REASON_SQL} AS escalation_reason,
       coalesce(array_to_string(ev.contents, ' | '), '') AS evidence, enr.evidence_count,
       TIMESTAMP '{AS_OF}' AS created_at
FROM enr LEFT JOIN tt ON tt.id = enr.ticket_id LEFT JOIN ev ON ev.th = tt.th""")
def _wf_recommendations(v):
    """IO6: recommendation rows of the enrichment."""
    return _outputs(v)["recommendations"]


@query("wf_analyses", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, 'ticket_intelligence' AS analysis_type, 'demo' AS model, category, priority, draft, evidence_count, top_source,
       TIMESTAMP '{AS_OF}' AS created_at FROM enr""")
def _wf_analyses(v):
    """IO6: stored analyses, with the fields read back from their JSON result."""
    def read(path):
        return F.get_json_object("result_json", path)
    found = F.from_json(read("$.evidence"), "array<struct<content: string, source: string>>")
    return _outputs(v)["analyses"].select(
        "ticket_id", "analysis_type", "model", read("$.category").alias("category"), read("$.priority").alias("priority"),
        read("$.draft").alias("draft"), F.coalesce(F.size(found), F.lit(0)).cast("bigint").alias("evidence_count"),
        F.try_element_at(found, F.lit(1))["source"].alias("top_source"), "created_at")


@query("wf_similarity", sql=f"""WITH {SIM_SQL}
SELECT ticket_id, matched_ticket_id, score, match_type, TIMESTAMP '{AS_OF}' AS created_at FROM top8""", floats=["score"])
def _wf_similarity(v):
    """IO6: the similarity rows that the enrichment stores."""
    from opsdesk.functions.time import as_timestamp
    from opsdesk.operators.similar import similar_tickets
    return similar_tickets(v.tickets)["similar"].drop("rank").withColumn("created_at", as_timestamp(AS_OF))


@query("wf_routing", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, team AS recommended_team, CAST(NULL AS VARCHAR) AS recommended_agent, routing_reason AS reason,
       confidence, TIMESTAMP '{AS_OF}' AS created_at FROM enr""", floats=["confidence"])
def _wf_routing(v):
    """IO6 + CL11: routing recommendation rows."""
    return _outputs(v)["routing"]


@query("wf_quality", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, confidence, safe AS validation_passed, FALSE AS human_edited,
       ticket_id IN (SELECT ticket_id FROM analyses) AS regenerated, evidence_count > 0 AS rag_evidence_available,
       mcp_used, mcp_succeeded, TIMESTAMP '{AS_OF}' AS created_at FROM enr""", floats=["confidence"])
def _wf_quality(v):
    """IO6 + W10: quality-metric rows (regenerated when an earlier analysis exists)."""
    return _outputs(v)["quality"]


@query("wf_ticket_update", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, category, intent, coalesce(priority, 'Medium') AS priority, coalesce(severity, 'Moderate') AS severity,
       sentiment, customer_impact, TIMESTAMP '{AS_OF}' AS updated_at FROM enr""")
def _wf_ticket_update(v):
    """U4: ticket columns updated from the enrichment."""
    return _outputs(v)["ticket_updates"]


@query("wf_audit", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, '{LX.EV_TOOL}' AS event_type,
       CASE WHEN mcp_succeeded THEN 'Controlled demo customer lookup completed.'
            ELSE 'Controlled demo customer lookup did not find a record.' END AS description, 0 AS seq, '{{}}' AS metadata_json
FROM enr WHERE mcp_used
UNION ALL SELECT ticket_id, '{LX.EV_ANALYSIS}', 'AI workflow completed in demo mode.', 1, '{{}}' FROM enr
UNION ALL SELECT ticket_id, '{LX.EV_ESCALATION}', {ESC_REASON_SQL}, 2, '{{}}' FROM enr WHERE escalation_required
UNION ALL SELECT ticket_id, '{LX.EV_SIMILAR}',
                 format('{{:d}} similar cases found; probable duplicates require agent review.', similar_count), 3,
                 format('{{{{"possible_duplicates": {{:d}}}}}}', duplicate_count)
FROM enr WHERE similar_count > 0""")
def _wf_audit(v):
    """CL16: audit events derived from the enrichment."""
    return _outputs(v)["audit"]


@query("resolution", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, investigation, recommended_steps, safe FROM enr""")
def _resolution(v):
    """CL5 + CL6 + CL9: investigation text, steps and rule-path draft safety."""
    return enriched_once(v).select("ticket_id", "investigation",
                              F.array_join("recommended_steps", " | ").alias("recommended_steps"), "safe")


@query("escalation", sql=f"""WITH {ENRICH_CTES}
SELECT ticket_id, escalation_required, {ESC_REASON_SQL} AS escalation_reason FROM enr""")
def _escalation(v):
    """CL7: escalation rule (Critical, or Billing without evidence, or breached SLA)."""
    return enriched_once(v).select("ticket_id", "escalation_required", "escalation_reason")


@query("draft_reply", sql=f"""WITH {ENRICH_CTES} SELECT ticket_id, draft FROM enr""")
def _draft_reply(v):
    """CL8: draft reply per ticket (SMS variant, evidence excerpt)."""
    return enriched_once(v).select("ticket_id", "draft")


# ----------------------------------------------------------------------------- light rule queries

@query("route", sql=f"""
SELECT id AS ticket_id, {_TEAM_SQL} AS team, '{LX.DEFAULT_AGENT}' AS agent,
       format('Routed based on {{}} category and ticket context.', category) AS reason, confidence
FROM ({classify_sql('subject', 'description', 'tickets', 'id')})""", floats=["confidence"])
def _route(v):
    """CL11: team routing from the rule category."""
    c = CL.classify(v.tickets, keep=["id"])
    r = RS.routing(F.col("category"), F.col("confidence"))
    return c.select(F.col("id").alias("ticket_id"), r.alias("r")).select("ticket_id", "r.team", "r.agent",
                                                                         "r.reason", "r.confidence")


@query("tool_gate", sql=f"""
SELECT c.id AS ticket_id, c.category, c.category IN ({_in_list(LX.TOOL_CATEGORIES)}) AS mcp_used,
       c.category IN ({_in_list(LX.TOOL_CATEGORIES)}) AND cu.id IS NOT NULL AS mcp_succeeded
FROM ({classify_sql('subject', 'description', 'tickets', 'id, customer_id')}) c
LEFT JOIN customers cu ON cu.id = c.customer_id""")
def _tool_gate(v):
    """CL4 + J8: category-gated customer lookup flags."""
    c = CL.classify(v.tickets, keep=["id", "customer_id"])
    return RS.tool_gate(c, v.customers).select(F.col("id").alias("ticket_id"), "category", "mcp_used",
                                               "mcp_succeeded")


@query("response_safety", sql=f"""
WITH d AS (SELECT draft_id, ticket_id, content FROM drafts),
i AS (SELECT draft_id, ticket_id, list_filter([
        CASE WHEN length({_strip_sql('content')}) < {LX.MIN_DRAFT_LENGTH} THEN '{LX.ISSUE_TOO_SHORT}' END,
        CASE WHEN regexp_matches(content, '{LX.GUARANTEE_PATTERN}') THEN '{LX.ISSUE_GUARANTEE}' END,
        CASE WHEN regexp_matches(content, '{LX.CARD_PATTERN}') THEN '{LX.ISSUE_CARD}' END,
        CASE WHEN regexp_matches(content, '{LX.POLICY_PATTERN}') THEN '{LX.ISSUE_POLICY}' END],
        lambda x: x IS NOT NULL) AS issues FROM d)
SELECT draft_id, ticket_id, array_to_string(issues, ' ') AS issues, len(issues) = 0 AS safe FROM i""")
def _response_safety(v):
    """CL10: safety check of every draft (no stored evidence)."""
    checked = RS.check_response(v.drafts, "content")
    return checked.select("draft_id", "ticket_id", F.array_join("issues", " ").alias("issues"), "safe")


@query("latest_analysis", sql="""
SELECT ticket_id, analysis_id, created_at, draft FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, analysis_id DESC) AS rn
  FROM analyses) WHERE rn = 1""")
def _latest_analysis(v):
    """Latest stored analysis per ticket."""
    return WF.latest_analysis(v.analyses)


@query("regenerated", sql="""
SELECT analysis_id, ticket_id, created_at,
       row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, analysis_id) > 1 AS regenerated
FROM analyses""")
def _regenerated(v):
    """Analyses that follow an earlier analysis of the same ticket."""
    return WF.regenerated_flags(v.analyses)


@query("timeline_build", sql="""
SELECT a.id, a.ticket_id, t.customer_id, a.event_type, a.actor_type, a.description AS summary,
       '{}' AS metadata_json, a.created_at
FROM audit_events a LEFT JOIN tickets t ON t.id = a.ticket_id WHERE a.ticket_id IS NOT NULL""")
def _timeline_build(v):
    """IO5: timeline events from audit events that carry a ticket."""
    return ST.build_timeline(v.audit_events, v.tickets)


@query("timeline", sql="""
SELECT ticket_id, id, event_type,
       array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '),
                                      lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') AS title,
       created_at
FROM audit_events WHERE ticket_id IS NOT NULL""")
def _timeline(v):
    """Timeline newest first with a title-cased label."""
    from opsdesk.operators.queue import timeline
    return timeline(ST.build_timeline(v.audit_events, v.tickets))


# ----------------------------------------------------------------------------- CL2 / CL3

def _enum_case(x: str, mapping: dict) -> str:
    return f"CASE lower({_strip_sql(x)}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_D = LX.PREDICTION_DEFAULTS
_LISTS = ["key_information", "missing_information", "uncertainty_flags"]
_STRS = ["category", "subcategory", "intent", "customer_impact", "urgency_reason"]


def _present(k: str) -> str:
    return f"list_contains(keys, '{k}')"


def _jstr(k: str) -> str:
    return f"json_extract_string(j, '$.{k}')"


NORMALIZE_SQL = f"""
pr AS (SELECT ticket_id, raw_json AS j FROM predictions),
good AS (SELECT ticket_id, j, json_type(j) = 'OBJECT' AS is_obj, json_keys(j) AS keys FROM pr WHERE json_valid(j)),
g1 AS (SELECT *,
         {_enum_case(_jstr('priority'), LX.PRIORITY_MAP)} AS m_priority,
         {_enum_case(_jstr('severity'), LX.SEVERITY_MAP)} AS m_severity,
         {_enum_case(_jstr('sentiment'), LX.SENTIMENT_MAP)} AS m_sentiment,
         TRY_CAST({_jstr('confidence')} AS DOUBLE) AS m_confidence,
         {", ".join(f"(json_type(j, '$.{k}') = 'ARRAY' AND len(list_filter(json_type(j, '$.{k}[*]'), lambda t: t <> 'VARCHAR')) = 0) AS ok_{k}" for k in _LISTS)},
         {", ".join(f"(json_type(j, '$.{k}') = 'VARCHAR' AND length({_strip_sql(_jstr(k))}) > 0) AS ok_{k}" for k in _STRS)}
       FROM good),
g2 AS (SELECT *, CASE WHEN NOT is_obj THEN 'AI response is not a JSON object.'
         {" ".join(f"WHEN {_present(k)} AND m_{k} IS NULL THEN 'AI returned an unsupported classification enum.'" for k in ("priority", "severity", "sentiment"))}
         WHEN {_present('confidence')} AND m_confidence IS NULL THEN 'AI field confidence is not a number.'
         {" ".join(f"WHEN {_present(k)} AND NOT coalesce(ok_{k}, FALSE) THEN 'AI field {k} must be a list of strings.'" for k in _LISTS)}
         {" ".join(f"WHEN {_present(k)} AND NOT coalesce(ok_{k}, FALSE) THEN 'AI field {k} is missing.'" for k in _STRS)}
         END AS error FROM g1),
norm AS (
  SELECT ticket_id, error IS NULL AS valid, error,
         {", ".join(f"CASE WHEN error IS NULL THEN CASE WHEN {_present(k)} THEN {_jstr(k)} ELSE '{_D[k]}' END END AS {k}" for k in _STRS)},
         {", ".join(f"CASE WHEN error IS NULL THEN CASE WHEN {_present(k)} THEN m_{k} ELSE '{_D[k]}' END END AS {k}" for k in ("priority", "severity", "sentiment"))},
         CASE WHEN error IS NULL THEN CASE WHEN {_present('confidence')} THEN greatest(0.0, least(1.0, m_confidence))
                                           ELSE {_D['confidence']} END END AS confidence,
         {", ".join(f"CASE WHEN error IS NULL THEN CASE WHEN {_present(k)} THEN array_to_string(CAST(json_extract_string(j, '$.{k}[*]') AS VARCHAR[]), '; ') ELSE '' END END AS {k}" for k in _LISTS)}
  FROM g2
  UNION ALL
  SELECT ticket_id, FALSE, 'AI response is not a JSON object.', {", ".join("NULL" for _ in _STRS)}, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL FROM pr WHERE NOT json_valid(j))"""

_NORM_COLS = ["valid", "error"] + _STRS + ["priority", "severity", "sentiment", "confidence"] + _LISTS


@query("normalize_predictions", sql=f"WITH {NORMALIZE_SQL} SELECT * FROM norm", floats=["confidence"])
def _normalize_predictions(v):
    """CL2: typed validation / normalisation of stored model JSON."""
    n = CL.normalize_predictions(v.predictions)
    return n.select("ticket_id", *[F.array_join(c, "; ").alias(c) if c in _LISTS else F.col(c) for c in _NORM_COLS])


@query("classify_fallback", sql=f"""WITH {NORMALIZE_SQL},
cl AS ({classify_sql('subject', 'description', 'tickets', 'id')})
SELECT cl.id AS ticket_id,
       CASE WHEN n.valid THEN 'model' WHEN n.valid IS NOT NULL THEN 'rules_fallback' ELSE 'rules' END AS mode,
       CASE WHEN n.valid THEN n.category ELSE cl.category END AS category,
       CASE WHEN n.valid THEN n.priority ELSE cl.priority END AS priority,
       CASE WHEN n.valid THEN n.severity ELSE cl.severity END AS severity,
       CASE WHEN n.valid THEN n.sentiment ELSE cl.sentiment END AS sentiment,
       CASE WHEN n.valid THEN n.confidence ELSE cl.confidence END AS confidence
FROM cl LEFT JOIN norm n ON n.ticket_id = cl.id""", floats=["confidence"])
def _classify_fallback(v):
    """CL3: valid model prediction, else rules (with the fallback mode tag)."""
    return CL.with_fallback(v.tickets, v.predictions).select(
        "ticket_id", "mode", "category", "priority", "severity", "sentiment", "confidence")


@query("similarity_counts", sql=f"""WITH {ENRICH_CTES}
SELECT (SELECT count(*) FROM top8) AS similar_count,
       (SELECT count(*) FROM top8 WHERE match_type = 'probable_duplicate') AS duplicate_count,
       (SELECT count_if(escalation_required) FROM enr) AS escalations""")
def _similarity_counts(v):
    """Similar / duplicate match counts and escalation recommendations of the enrichment."""
    from opsdesk.operators.metrics import similarity_counts
    from opsdesk.operators.similar import similar_tickets
    e = enriched_once(v)
    matches = similar_tickets(v.tickets)["similar"]
    return similarity_counts(matches, e.select("escalation_required"))
