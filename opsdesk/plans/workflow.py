"""CL12 ticket enrichment as one lazy plan, and its split into output tables (IO6, CL16, U4, W10).

classify (CL1/CL3) → retrieve (RET1, k=4) → similar cases (SIM1) → tool gate (CL4) →
investigate (CL5-CL9, SLA3) → route (CL11).

Retrieval and similarity depend only on the ticket text, so they run once per distinct
text (sha-256 of subject + " " + description) and are joined back by that hash.  The
enriched frame feeds several outputs; ``materialize`` persists it once (or checkpoints it to
the shared ``spark.checkpoint.dir``) before it is split.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.functions.time import as_timestamp

from opsdesk.functions import lexicon as LX
from opsdesk.operators import classify as CL
from opsdesk.operators import resolve as RS
from opsdesk.operators import retrieve as R
from opsdesk.operators import similar as SIM
from opsdesk.operators import sla as SLA
from opsdesk.session import stored


def text_hash(subject: str = "subject", description: str = "description"):
    return F.sha2(SIM.ticket_text(subject, description), 256)


def evidence_by_text(tickets: DataFrame, knowledge, k: int) -> DataFrame:
    """Top-k evidence per distinct ticket text as an array ordered by rank (≤ k entries);
    ``knowledge`` is a ``VectorIndex`` or a ``ChunkCorpus``."""
    texts = tickets.select(text_hash().alias("qid"), SIM.ticket_text().alias("text")).distinct()
    hits = knowledge.retrieve(texts, k)
    return hits.groupBy(F.col("qid").alias("th")).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "content", F.col("filename").alias("source"), "document_type", "score", "chunk_index")))
        .alias("evidence"))


def enrich_tickets(tickets: DataFrame, customers: DataFrame, knowledge, ticket_sla: DataFrame, as_of, predictions: DataFrame | None = None,
                   k: int = LX.K_WORKFLOW, materialize: str | None = None,
                   materialize_input: str | None = "checkpoint") -> DataFrame:
    """CL12: one enriched row per ticket.

    ``materialize_input`` = "checkpoint" (default): the narrow ticket projection every branch
    needs is written once to the shared checkpoint folder (a lineage cut) instead of being
    re-derived by each branch (classification, evidence, similar cases, SLA, tool gate);
    "persist" keeps it in memory/disk; None re-derives it per branch.  ``materialize`` does
    the same for the enriched result when it feeds several outputs (IO6)."""
    out = with_evidence(*enrich_parts(tickets, customers, knowledge, ticket_sla, as_of, predictions, k, materialize_input))
    if materialize == "persist":
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    elif materialize == "checkpoint":
        out = out.checkpoint()  # reliable: written under spark.checkpoint.dir
    return out


def enrich_parts(tickets: DataFrame, customers: DataFrame, knowledge, ticket_sla: DataFrame, as_of, predictions: DataFrame | None = None,
                 k: int = LX.K_WORKFLOW, materialize_input: str | None = "checkpoint") -> tuple[DataFrame, DataFrame]:
    """The two parts of an enrichment: a row per ticket without evidence, and the evidence per text
    (th).  Evidence is several times as wide as a ticket, so it is joined last (``with_evidence``) and
    neither shuffled nor stored per ticket."""
    cols = ["id", "customer_id", "channel", "subject", "description", "status", "created_at"]
    if materialize_input == "checkpoint":
        tickets = stored(tickets.select(*cols), "enrich-input")
    elif materialize_input == "persist":
        tickets = tickets.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    a = CL.with_fallback(tickets, predictions)
    base = tickets.select(F.col("id").alias("ticket_id"), "customer_id", "channel", "description", text_hash().alias("th"))
    ev = evidence_by_text(tickets, knowledge, k)
    sim = SIM.similar_tickets(tickets)
    sla = SLA.sla_assessment(tickets, ticket_sla, as_of).select(
        "ticket_id", F.col("resolution_status").alias("sla_resolution_status"))
    j = base.join(a, "ticket_id", "inner").join(sim["similar_counts"], "ticket_id", "left") \
        .join(sim["duplicate_counts"], "ticket_id", "left").join(sla, "ticket_id", "left")
    rows = RS.tool_gate(j, customers).select(
        "ticket_id", "customer_id", "channel", "description", "th", "mode", "category", "subcategory", "intent", "priority", "severity",
        "sentiment", "customer_impact", "confidence", "missing_information",
        F.coalesce("similar_count", F.lit(0)).cast("bigint").alias("similar_count"),
        F.coalesce("duplicate_count", F.lit(0)).cast("bigint").alias("duplicate_count"),
        "sla_resolution_status", "mcp_used", "mcp_succeeded")
    return rows, ev


def with_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Enriched rows from the two parts: the evidence of the ticket's text and all that follows from it."""
    found = F.coalesce(F.col("evidence"), F.array().cast(
        "array<struct<rank:int,content:string,source:string,document_type:string,score:double,chunk_index:int>>"))
    j = rows.join(evidence, "th", "left").withColumn("evidence", found)
    has_ev = F.size("evidence") > 0
    escalate = RS.escalation_required(F.col("severity"), F.col("category"), has_ev, F.col("sla_resolution_status"))
    safe = RS.rule_draft_safe(F.col("description"), has_ev)
    route = RS.routing(F.col("category"), F.col("confidence"))
    return j.select(
        "ticket_id", "customer_id", "channel", "mode", "category", "subcategory", "intent", "priority", "severity",
        "sentiment", "customer_impact", "confidence", "missing_information", "evidence",
        F.size("evidence").alias("evidence_count"), "similar_count", "duplicate_count",
        "sla_resolution_status", "mcp_used", "mcp_succeeded",
        RS.investigation(F.transform("evidence", lambda h: h["content"])).alias("investigation"),
        F.concat(F.col("intent"), F.lit(": "), F.substring("description", 1, 140)).alias("problem_summary"),
        RS.recommended_steps(F.col("missing_information"), has_ev).alias("recommended_steps"),
        escalate.alias("escalation_required"), RS.escalation_reason(escalate).alias("escalation_reason"),
        RS.draft_reply(F.col("channel"), F.col("description"),
                       F.try_element_at("evidence", F.lit(1))["content"]).alias("draft"),
        safe.alias("safe"),
        F.when(safe, F.array().cast("array<string>")).otherwise(F.array(F.lit(LX.UNSAFE_REFUND_ISSUE)))
         .alias("validation_issues"),
        route.alias("routing"),
    )


def regenerated_flags(analyses: DataFrame) -> DataFrame:
    """An analysis is a regeneration when an earlier analysis of the same ticket exists.
    First analysis per ticket by min_by (partial aggregate) joined back — no per-ticket sort."""
    first = analyses.groupBy("ticket_id").agg(F.min_by("analysis_id", F.struct("created_at", "analysis_id"))
                                              .alias("first_id"))
    return analyses.join(first, "ticket_id", "inner").select(
        "analysis_id", "ticket_id", "created_at", (F.col("analysis_id") != F.col("first_id")).alias("regenerated"))


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Latest analysis per ticket by (created_at, analysis_id) — max_by, no sort."""
    return analyses.groupBy("ticket_id").agg(
        F.max_by(F.struct("analysis_id", "created_at", "draft"), F.struct("created_at", "analysis_id")).alias("a")
    ).select("ticket_id", "a.analysis_id", "a.created_at", "a.draft")


def split_outputs(enriched: DataFrame, history: DataFrame | None, as_of) -> dict[str, DataFrame]:
    """IO6 + U4 + CL16: the six persisted tables plus audit events, each a projection of
    the one enriched frame."""
    stamp = as_timestamp(as_of)
    e = enriched
    analyses = e.select("ticket_id", F.lit("ticket_intelligence").alias("analysis_type"),
                        F.when(F.col("mode") == "model", "model").otherwise("demo").alias("model"),
                        F.to_json(F.struct("category", "intent", "priority", "severity", "sentiment", "confidence",
                                           "draft", "evidence")).alias("result_json"), stamp.alias("created_at"))
    updates = e.select("ticket_id", "category", "intent", F.coalesce("priority", F.lit("Medium")).alias("priority"),
                       F.coalesce("severity", F.lit("Moderate")).alias("severity"), "sentiment", "customer_impact",
                       stamp.alias("updated_at"))
    recommendations = e.select("ticket_id", "problem_summary",
                               F.lit(LX.LIKELY_CAUSE).alias("likely_cause"),
                               F.array_join("recommended_steps", " | ").alias("recommended_steps"),
                               F.lit(" | ".join(LX.REQUIRED_CHECKS)).alias("required_checks"),
                               F.lit(LX.CUSTOMER_ACTION).alias("customer_action"),
                               F.lit(LX.INTERNAL_ACTION).alias("internal_action"),
                               "escalation_required", "escalation_reason",
                               F.array_join(F.transform("evidence", lambda h: h["content"]), " | ").alias("evidence"),
                               F.col("evidence_count").cast("bigint").alias("evidence_count"),
                               stamp.alias("created_at"))
    routing = e.select("ticket_id", F.col("routing.team").alias("recommended_team"),
                       F.lit(None).cast("string").alias("recommended_agent"), F.col("routing.reason").alias("reason"),
                       F.col("routing.confidence").alias("confidence"), stamp.alias("created_at"))
    quality = e.select("ticket_id", "confidence", F.col("safe").alias("validation_passed"),
                       F.lit(False).alias("human_edited"), F.lit(False).alias("regenerated"),
                       (F.col("evidence_count") > 0).alias("rag_evidence_available"), "mcp_used", "mcp_succeeded",
                       stamp.alias("created_at"))
    if history is not None:                       # only these rows meet the history: no evidence is shuffled
        prior = history.select("ticket_id").distinct().withColumn("had_prior", F.lit(True))
        quality = quality.join(prior, "ticket_id", "left") \
            .withColumn("regenerated", F.coalesce("had_prior", F.lit(False))).drop("had_prior")
    audit = e.select("ticket_id", F.explode(F.filter(F.array(
        F.when(F.col("mcp_used"), F.struct(F.lit(LX.EV_TOOL).alias("event_type"),
                                           F.when(F.col("mcp_succeeded"),
                                                  F.lit("Controlled demo customer lookup completed."))
                                           .otherwise(F.lit("Controlled demo customer lookup did not find a record."))
                                           .alias("description"), F.lit(0).alias("seq"))),
        F.struct(F.lit(LX.EV_ANALYSIS).alias("event_type"),
                 F.concat(F.lit("AI workflow completed in "), F.when(F.col("mode") == "model", "model")
                          .otherwise("demo"), F.lit(" mode.")).alias("description"), F.lit(1).alias("seq")),
        F.when(F.col("escalation_required"), F.struct(F.lit(LX.EV_ESCALATION).alias("event_type"),
                                                      F.col("escalation_reason").alias("description"),
                                                      F.lit(2).alias("seq"))),
        F.when(F.col("similar_count") > 0, F.struct(
            F.lit(LX.EV_SIMILAR).alias("event_type"),
            F.format_string("%d similar cases found; probable duplicates require agent review.",
                            F.col("similar_count")).alias("description"), F.lit(3).alias("seq"))),
    ), lambda x: x.isNotNull())).alias("ev"), "duplicate_count").select(
        "ticket_id", "ev.event_type", "ev.description", "ev.seq",
        F.when(F.col("ev.event_type") == LX.EV_SIMILAR, F.format_string('{"possible_duplicates": %d}', F.col("duplicate_count")))
        .otherwise(F.lit("{}")).alias("metadata_json"))
    return {"analyses": analyses, "ticket_updates": updates, "recommendations": recommendations,
            "routing": routing, "quality": quality, "audit": audit}


def answer_context(questions: DataFrame, tickets: DataFrame, history: DataFrame, knowledge,
                   k: int = LX.K_COPILOT, history_n: int = 8) -> DataFrame:
    """CL14 + W7: copilot context pack per question — the ticket, its top-k evidence (text, source,
    type, score), the last ``history_n`` messages oldest first (direction, sender, text, time) — and
    the rule answer text.  The model call itself is not built."""
    from opsdesk.operators.queue import last_n

    t = tickets.select(F.col("id").alias("ticket_id"), "subject", "description", text_hash().alias("th"))
    q = questions.join(t, "ticket_id", "inner")
    ev = evidence_by_text(tickets.join(questions.select(F.col("ticket_id").alias("id")).distinct(), "id",
                                       "left_semi"), knowledge, k)
    hist = last_n(history, "ticket_id", [F.col("created_at").desc(), F.col("id").desc()], history_n, "back") \
        .groupBy("ticket_id").agg(F.sort_array(F.collect_list(F.struct(  # at most history_n rows a ticket
            (-F.col("back")).alias("place"), "direction", "sender", "content", "created_at"))).alias("history"))
    j = q.join(ev, "th", "left").join(hist, "ticket_id", "left")
    top = F.try_element_at("evidence", F.lit(1))
    answer = F.concat(F.lit("Demo copilot: review **"), F.col("subject"), F.lit("**. "),
                      F.when(top.isNotNull(), F.concat(F.substring(top["content"], 1, 500), F.lit(" (Source: "),
                                                       top["source"], F.lit(")")))
                      .otherwise(F.lit("No matching knowledge evidence was found; verify with the responsible "
                                       "team before advising the customer.")))
    return j.select("question_id", "ticket_id", "subject", "description", "evidence", "history",
                    F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"),
                    F.coalesce(F.size("history"), F.lit(0)).cast("bigint").alias("history_count"),
                    answer.alias("answer"))
