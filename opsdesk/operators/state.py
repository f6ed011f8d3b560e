"""Batch state changes expressed as joins (IO5, U1, U2, U8, U9).

Nothing is mutated in place: each operator returns the new version of a table (or the rows
to append), so a job can write it atomically as a new directory / table version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.predicates import is_closed


def build_timeline(audit_events: DataFrame, tickets: DataFrame) -> DataFrame:
    """IO5: audit events that carry a ticket become timeline events with the ticket's customer
    (left join — an unknown ticket keeps a null customer); metadata defaults to '{}'."""
    t = tickets.select(F.col("id").alias("ticket_id"), "customer_id")
    a = audit_events.where(F.col("ticket_id").isNotNull())
    meta = F.col("metadata_json") if "metadata_json" in audit_events.columns else F.lit("{}")
    return a.join(t, "ticket_id", "left").select(
        "id", "ticket_id", "customer_id", "event_type", "actor_type", F.col("description").alias("summary"),
        F.coalesce(meta, F.lit("{}")).alias("metadata_json"), "created_at")


def apply_status_changes(tickets: DataFrame, changes: DataFrame) -> dict:
    """U1 + P16: latest valid change per ticket wins; resolved_at = change time for
    Resolved/Closed, else null (re-opening clears it).  Invalid statuses are rejected."""
    valid = changes.where(F.col("status").isin(*LX.STATUSES))
    rejected = changes.where(~F.col("status").isin(*LX.STATUSES) | F.col("status").isNull()) \
        .withColumn("error", F.lit(LX.ERR_STATUS))
    latest = valid.groupBy("ticket_id").agg(
        F.max_by(F.struct("status", "changed_at"), F.struct("changed_at", "change_id")).alias("c"),
        F.count(F.lit(1)).alias("changes_applied"))
    t = tickets.select(F.col("id").alias("ticket_id"), F.col("status").alias("old_status"))
    j = t.join(latest, "ticket_id", "inner")
    updated = j.select("ticket_id", "old_status", F.col("c.status").alias("status"),
                       F.col("c.changed_at").alias("updated_at"),
                       F.when(is_closed("c.status"), F.col("c.changed_at")).alias("resolved_at"),
                       "changes_applied")
    audit = valid.join(t.select("ticket_id"), "ticket_id", "left_semi").select(
        "ticket_id", F.lit(LX.EV_STATUS).alias("event_type"),
        F.concat(F.lit("Ticket status changed to "), F.col("status"), F.lit(".")).alias("description"),
        F.col("changed_at").alias("created_at"))
    return {"updated": updated, "rejected": rejected, "audit": audit}


def accept_routing(tickets: DataFrame, recommendations: DataFrame, requests: DataFrame) -> DataFrame:
    """U2 + W2: copy the latest recommendation's team (agent or 'Unassigned') onto each
    requested ticket and mark all its recommendations accepted; error when none exists."""
    latest = recommendations.groupBy("ticket_id").agg(
        F.max_by(F.struct("recommended_team", "recommended_agent"), F.struct("created_at", "id")).alias("r"),
        F.count(F.lit(1)).alias("accepted_recommendations"))
    req = requests.select("ticket_id").distinct().join(tickets.select(F.col("id").alias("ticket_id")),
                                                        "ticket_id", "left_semi")
    j = req.join(latest, "ticket_id", "left")
    return j.select(
        "ticket_id", F.col("r.recommended_team").alias("assigned_team"),
        F.when(F.col("r").isNotNull(), F.coalesce(F.col("r.recommended_agent"), F.lit(LX.DEFAULT_AGENT)))
         .alias("assigned_agent"),
        F.coalesce(F.col("accepted_recommendations"), F.lit(0)).cast("bigint").alias("accepted_recommendations"),
        F.when(F.col("r").isNull(), F.lit("Run AI analysis to create a routing recommendation first."))
         .alias("error"))


def publish_policy(policies: DataFrame, new_policy: DataFrame) -> DataFrame:
    """U8: deactivate every policy and add the new one (hours × 60 → minutes)."""
    old = policies.withColumn("active", F.lit(False))
    new = new_policy.select(
        "id", "name", (F.col("first_response_hours") * 60).cast("int").alias("first_response_minutes"),
        (F.col("resolution_hours") * 60).cast("int").alias("resolution_minutes"),
        F.lit(True).alias("active"), "created_at")
    return old.select(*new.columns).unionByName(new)


def fk_violations(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Counts of child rows whose (non-null) key has no parent — one left anti join per FK."""
    frames = []
    for name, child, ckey, parent, pkey in checks:
        orphans = child.where(F.col(ckey).isNotNull()).join(
            parent.select(F.col(pkey).alias(ckey)).distinct(), ckey, "left_anti")
        frames.append(orphans.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("foreign_key"), "violations"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
