"""SLA operators: SLA1 (clock states), SLA2 (due-time assignment), SLA3 (workflow assessment),
W11 (oldest active policy), A9-A11 (dashboard, health buckets, risk list).

Clock arithmetic is done in microseconds (``timestamp_diff``) so the at-risk windows are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions.time import as_timestamp

from opsdesk.functions.lexicon import FIRST_RESPONSE_AT_RISK_SECONDS, RESOLUTION_AT_RISK_SECONDS
from opsdesk.functions.predicates import is_closed, is_open

_US = 1_000_000
RISK_STATES = ["at_risk", "breached"]
GOOD_STATES = ["met", "on_track"]
HEALTH_LABELS = ["On Time", "At Risk", "Breached"]


def _ts(as_of) -> Column:
    return as_timestamp(as_of)


def micros_until(due: Column, as_of) -> Column:
    return F.timestamp_diff("MICROSECOND", _ts(as_of), due)


def clock_state(due: Column, as_of, at_risk_seconds: int, done: Column | None = None) -> Column:
    """met (when ``done``) → not_configured → breached → at_risk → on_track."""
    left = micros_until(due, as_of)
    expr = F.when(due.isNull(), "not_configured").when(left < 0, "breached") \
        .when(left <= at_risk_seconds * _US, "at_risk").otherwise("on_track")
    if done is not None:
        expr = F.when(done, "met").otherwise(expr)
    return expr


def replied_tickets(messages: DataFrame) -> DataFrame:
    """Tickets with at least one outbound message (one row per ticket, partial-aggregated)."""
    return messages.where(F.col("direction") == "outbound").select("ticket_id").distinct() \
        .withColumn("has_reply", F.lit(True))


def sla_state(tickets: DataFrame, ticket_sla: DataFrame, messages: DataFrame, as_of) -> DataFrame:
    """SLA1: state of both clocks at ``as_of``; tickets without an SLA row have no state."""
    t = tickets.select(F.col("id").alias("ticket_id"), F.col("status").alias("ticket_status"))
    s = ticket_sla.join(t, "ticket_id", "inner").join(replied_tickets(messages), "ticket_id", "left")
    return s.select(
        "ticket_id", "ticket_status", "first_response_due_at", "resolution_due_at",
        clock_state(F.col("first_response_due_at"), as_of, FIRST_RESPONSE_AT_RISK_SECONDS,
                    F.coalesce(F.col("has_reply"), F.lit(False))).alias("first_response_status"),
        clock_state(F.col("resolution_due_at"), as_of, RESOLUTION_AT_RISK_SECONDS,
                    is_closed("ticket_status")).alias("resolution_status"),
    )


def first_active_policy(policies: DataFrame) -> DataFrame:
    """The oldest active policy, as a one-row frame (empty when none is active)."""
    best = policies.where(F.col("active")).agg(
        F.min_by(F.struct("id", "first_response_minutes", "resolution_minutes"),
                 F.struct("created_at", "id")).alias("p"))
    return best.where(F.col("p").isNotNull()).select(
        F.col("p.id").alias("policy_id"), F.col("p.first_response_minutes").alias("first_response_minutes"),
        F.col("p.resolution_minutes").alias("resolution_minutes"))


def sla_assign(tickets: DataFrame, policies: DataFrame) -> DataFrame:
    """SLA2: due times from the oldest active policy; no active policy → no rows.

    The policy is one aggregated value, attached to every ticket as a scalar subquery."""
    pol = first_active_policy(policies).select(F.struct("*").alias("p")).scalar()  # one value, no join
    j = tickets.select(F.col("id").alias("ticket_id"), "created_at", pol.alias("p")).where(F.col("p").isNotNull()) \
        .select("ticket_id", "created_at", "p.*")
    return j.select(
        "ticket_id", "policy_id",
        F.timestamp_add("MINUTE", F.col("first_response_minutes"), F.col("created_at")).alias("first_response_due_at"),
        F.timestamp_add("MINUTE", F.col("resolution_minutes"), F.col("created_at")).alias("resolution_due_at"),
        F.lit("on_track").alias("first_response_status"),
        F.lit("on_track").alias("resolution_status"),
    )


def sla_assessment(tickets: DataFrame, ticket_sla: DataFrame, as_of) -> DataFrame:
    """SLA3: stored first-response status (default on_track), computed resolution state and
    remaining seconds; tickets without a row are ``not_configured``."""
    s = ticket_sla.select("ticket_id", F.col("first_response_status").alias("stored_first"),
                          "resolution_due_at", F.lit(True).alias("configured"))
    j = tickets.select(F.col("id").alias("ticket_id"), "status").join(s, "ticket_id", "left")
    configured = F.coalesce(F.col("configured"), F.lit(False))
    due = F.col("resolution_due_at")
    return j.select(
        "ticket_id",
        configured.alias("configured"),
        F.when(configured, F.coalesce(F.col("stored_first"), F.lit("on_track")))
         .otherwise("not_configured").alias("first_response_status"),
        F.when(configured, clock_state(due, as_of, RESOLUTION_AT_RISK_SECONDS, is_closed("status")))
         .otherwise("not_configured").alias("resolution_status"),
        due.alias("resolution_due_at"),
        (micros_until(due, as_of) / F.lit(float(_US))).alias("remaining_seconds"),
    )


def sla_dashboard(states: DataFrame, tickets: DataFrame) -> DataFrame:
    """Risk count (either clock at risk/breached), met count and rate, resolution rate."""
    first, res = F.col("first_response_status"), F.col("resolution_status")
    s = states.agg(
        F.count_if(first.isin(*RISK_STATES) | res.isin(*RISK_STATES)).alias("sla_risks"),
        F.count_if(first.isin(*GOOD_STATES) & res.isin(*GOOD_STATES)).alias("sla_met"),
        F.count(F.lit(1)).alias("sla_rows"))
    t = tickets.agg(F.struct(F.count_if(is_closed()).alias("resolved"), F.count(F.lit(1)).alias("total"))
                    .alias("t")).scalar()
    j = s.select("*", t["resolved"].alias("resolved"), t["total"].alias("total"))  # scalar subquery, no join
    return j.select(
        "sla_risks", "sla_met", "sla_rows", "resolved", "total",
        (F.col("sla_met") / F.greatest(F.lit(1), F.col("sla_rows"))).alias("met_rate"),
        (F.col("resolved") / F.greatest(F.lit(1), F.col("total"))).alias("resolution_rate"),
    )


def health_bucket(first: Column, res: Column) -> Column:
    """A10: Breached > At Risk > On Time by the worse clock (not_configured counts as On Time)."""
    return F.when((first == "breached") | (res == "breached"), "Breached") \
        .when((first == "at_risk") | (res == "at_risk"), "At Risk").otherwise("On Time")


def sla_health(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A10: bucket counts with zero fill and shares over the SLA rows (optionally per group): one
    aggregate that counts all buckets and the total, unfolded to a row per bucket."""
    by = by or []
    b = states.select(*by, health_bucket(F.col("first_response_status"), F.col("resolution_status")).alias("_bucket"))
    counts = b.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"),
                                *[F.count_if(F.col("_bucket") == x).alias(f"_n{i}") for i, x in enumerate(HEALTH_LABELS)])
    buckets = F.array(*[F.struct(F.lit(x).alias("bucket"), F.lit(i).alias("bucket_order"), F.col(f"_n{i}").alias("tickets"))
                        for i, x in enumerate(HEALTH_LABELS)])
    return counts.select(*by, "_rows", F.inline(buckets)).select(
        *by, "bucket", "bucket_order", "tickets", (F.col("tickets") / F.greatest(F.lit(1), F.col("_rows"))).alias("share"))


def sla_risks(tickets: DataFrame, states: DataFrame) -> DataFrame:
    """Open tickets whose resolution clock is at risk or breached."""
    t = tickets.where(is_open()).select(F.col("id").alias("ticket_id"), "subject")
    s = states.where(F.col("resolution_status").isin(*RISK_STATES)) \
        .select("ticket_id", "resolution_status", "resolution_due_at")
    return t.join(s, "ticket_id", "inner")
