"""Operational and quality aggregates.

Every metric is a single pass with partial (map-side) aggregation; counters from other tables
are attached as scalar subqueries (evaluated once, no join).  Zero-filled grids are generated with
``explode`` over a literal array — no join against a dimension table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions.time import as_timestamp

from opsdesk.functions.predicates import (category_or_unclassified, is_closed, is_high, is_kpi_open, is_open)

SERIES = ["Open tickets", "Resolved", "Escalated"]
HIST_LABELS = ["0–50%", "50–70%", "70–90%", "90–100%"]


def _n() -> Column:
    return F.count(F.lit(1))


def kpi_metrics(tickets: DataFrame, customers: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """A1: headline counters (one row)."""
    t = tickets.agg(
        _n().alias("total"),
        F.count_if(is_kpi_open()).alias("open"),
        F.count_if(is_high() & is_open()).alias("high"),
        F.count_if(is_closed()).alias("resolved"),
        F.count_if((F.col("status") == "Escalated") | (F.col("severity") == "Critical")).alias("escalated_or_critical"),
    )
    # the other tables' counters are scalar subqueries: evaluated once, no join
    c = customers.agg(_n().alias("customers")).scalar()
    m = messages.agg(_n().alias("messages")).scalar()
    f = feedback.agg(F.count_if(F.col("status") == "New").alias("pending_feedback")).scalar()
    return t.select("*", c.alias("customers"), m.alias("messages"), f.alias("pending_feedback"))


def brief_counts(tickets: DataFrame, as_of) -> DataFrame:
    """A2: tickets created on the ``as_of`` UTC date, open, open high-priority, escalated."""
    day = F.to_date(as_timestamp(as_of))
    return tickets.agg(
        F.count_if(F.to_date("created_at") == day).alias("tickets_today"),
        F.count_if(is_open()).alias("open"),
        F.count_if(is_open() & is_high()).alias("high_priority"),
        F.count_if(F.col("status") == "Escalated").alias("escalated"),
    )


def category_counts(tickets: DataFrame) -> DataFrame:
    """A3: category counts (missing → Unclassified), most common first, then by name."""
    return tickets.groupBy(category_or_unclassified().alias("category")).agg(_n().alias("tickets")) \
        .orderBy(F.col("tickets").desc(), F.col("category").asc())


def quality_signal(quality: DataFrame) -> DataFrame:
    """A4: analyses, mean confidence (null as 0; null when empty), validation failures,
    evidence rate, tool failures."""
    n = _n()
    return quality.agg(
        n.alias("analyses"),
        F.when(n > 0, F.avg(F.coalesce(F.col("confidence"), F.lit(0.0)))).alias("average_confidence"),
        F.count_if(~F.col("validation_passed")).alias("validation_failures"),
        F.when(n > 0, F.count_if(F.col("rag_evidence_available")) / n).alias("rag_evidence_rate"),
        F.count_if(F.col("mcp_used") & ~F.col("mcp_succeeded")).alias("mcp_failures"),
    )


def value_counts(tickets: DataFrame) -> DataFrame:
    """A5: counts for category / priority / sentiment / channel in one pass (stack → groupBy).
    Missing category → Unclassified, missing sentiment → Not analyzed; missing priority or
    channel are not counted."""
    stacked = tickets.select(F.inline(F.array(
        F.struct(F.lit("category").alias("dimension"), category_or_unclassified().alias("value")),
        F.struct(F.lit("priority").alias("dimension"), F.col("priority").alias("value")),
        F.struct(F.lit("sentiment").alias("dimension"),
                 F.coalesce(F.col("sentiment"), F.lit("Not analyzed")).alias("value")),
        F.struct(F.lit("channel").alias("dimension"), F.col("channel").alias("value")),
    )))
    return stacked.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(_n().alias("tickets"))


def analytics_tiles(tickets: DataFrame) -> DataFrame:
    """Tickets, open (P13), escalated (status), distinct channels."""
    return tickets.agg(_n().alias("tickets"), F.count_if(is_kpi_open()).alias("open"),
                       F.count_if(F.col("status") == "Escalated").alias("escalated"),
                       F.count_distinct("channel").alias("channels"))


def daily_volume(tickets: DataFrame) -> DataFrame:
    """Tickets per UTC day (days with tickets only)."""
    return tickets.groupBy(F.to_date("created_at").alias("day")).agg(_n().alias("tickets"))


def status_series(status: Column) -> Column:
    return F.when(status.isin("Open", "In Progress", "Pending"), "Open tickets") \
        .when(status.isin("Resolved", "Closed"), "Resolved").when(status == "Escalated", "Escalated")


def volume_trend(tickets: DataFrame, as_of, days: int = 7) -> DataFrame:
    """7 days ending at the ``as_of`` date × 3 series, zero filled."""
    end = F.to_date(as_timestamp(as_of))
    start = F.date_sub(end, days - 1)
    counts = tickets.select(F.to_date("created_at").alias("day"), status_series(F.col("status")).alias("series")) \
        .where(F.col("series").isNotNull() & (F.col("day") >= start) & (F.col("day") <= end)) \
        .groupBy("day", "series").agg(_n().alias("tickets"))
    grid = tickets.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day")) \
        .select("day", F.explode(F.array(*[F.lit(s) for s in SERIES])).alias("series"))
    return grid.join(counts, ["day", "series"], "left") \
        .select("day", "series", F.coalesce(F.col("tickets"), F.lit(0)).cast("bigint").alias("tickets"))


def customer_360(customers: DataFrame, tickets: DataFrame) -> DataFrame:
    """A12 + S8: per customer total, open (P12), resolved, escalated, listed by name; customers
    with no tickets show zeros."""
    agg = tickets.groupBy(F.col("customer_id").alias("id")).agg(
        _n().alias("total"), F.count_if(is_open()).alias("open"),
        F.count_if(is_closed()).alias("resolved"), F.count_if(F.col("status") == "Escalated").alias("escalated"))
    j = customers.select("id", "name").join(agg, "id", "left")
    return j.select(F.col("id").alias("customer_id"), "name",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                      for c in ("total", "open", "resolved", "escalated")]).orderBy("name", "customer_id")


def customer_channels(tickets: DataFrame) -> DataFrame:
    """Sorted distinct channels per customer (set size bounded by the channel enum)."""
    return tickets.groupBy("customer_id").agg(
        F.array_join(F.sort_array(F.collect_set("channel")), ", ").alias("channels"))


def ticket_context(tickets: DataFrame) -> DataFrame:
    """Each ticket with its customer's ticket count (aggregate + join, no per-customer window)."""
    counts = tickets.groupBy("customer_id").agg(_n().alias("customer_tickets"))
    return tickets.select(F.col("id").alias("ticket_id"), "customer_id").join(counts, "customer_id", "inner")


def quality_kpis(quality: DataFrame, messages: DataFrame, accepted_status: str = "demo_sent",
                 approx_distinct: bool = False) -> DataFrame:
    """Acceptance rate, mean confidence (null as 0), edit / failure / regenerated rates and sums.
    ``approx_distinct`` switches the two distinct-ticket counts to HyperLogLog sketches
    (``approx_count_distinct``, ~1 % error, fixed memory) for very large inputs; exact by default."""
    distinct = F.approx_count_distinct if approx_distinct else F.count_distinct
    approved = messages.where((F.col("direction") == "outbound") & (F.col("delivery_status") == accepted_status)) \
        .agg(distinct("ticket_id").alias("approved_tickets"))
    n = _n()
    q = quality.agg(
        n.alias("analyses"),
        distinct("ticket_id").alias("analyzed_tickets"),
        F.avg(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("avg_confidence"),
        F.avg(F.col("human_edited").cast("int")).alias("edit_rate"),
        F.avg((~F.col("validation_passed")).cast("int")).alias("failure_rate"),
        F.avg(F.col("regenerated").cast("int")).alias("regenerated_rate"),
        F.sum(F.col("human_edited").cast("int")).cast("bigint").alias("human_edits"),
        F.count_if(~F.col("validation_passed")).alias("validation_failures"),
        F.sum(F.col("regenerated").cast("int")).cast("bigint").alias("regenerated"),
    )
    j = q.select("*", approved.scalar().alias("approved_tickets"))  # scalar subquery, no join
    return j.select("*", (F.col("approved_tickets") / F.greatest(F.lit(1), F.col("analyzed_tickets")))
                    .alias("acceptance_rate"))


def similarity_counts(matches: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Similar / duplicate / escalation counts."""
    m = matches.agg(
        F.count_if(F.col("match_type").isin("similar", "resolved_case", "probable_duplicate")).alias("similar_count"),
        F.count_if(F.col("match_type") == "probable_duplicate").alias("duplicate_count"))
    r = recommendations.agg(F.count_if(F.col("escalation_required")).alias("escalations")).scalar()
    return m.select("*", r.alias("escalations"))


def quality_trend(quality: DataFrame) -> DataFrame:
    """Daily validation pass rate × 100."""
    return quality.groupBy(F.to_date("created_at").alias("day")).agg(
        (F.avg(F.col("validation_passed").cast("int")) * 100).alias("acceptance"))


def confidence_bin(conf: Column) -> Column:
    """A19 bins, right-closed with the lowest edge included: [0,.5] (.5,.7] (.7,.9] (.9,1.0001]."""
    c = F.coalesce(conf, F.lit(0.0))
    return F.when((c >= 0) & (c <= 0.5), HIST_LABELS[0]).when((c > 0.5) & (c <= 0.7), HIST_LABELS[1]) \
        .when((c > 0.7) & (c <= 0.9), HIST_LABELS[2]).when((c > 0.9) & (c <= 1.0001), HIST_LABELS[3])


def confidence_hist(quality: DataFrame) -> DataFrame:
    """Confidence histogram with empty bins kept as 0 (out-of-range values dropped)."""
    counts = quality.select(confidence_bin(F.col("confidence")).alias("bucket")).where(F.col("bucket").isNotNull()) \
        .groupBy("bucket").agg(_n().alias("analyses"))
    grid = quality.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in HIST_LABELS])).alias("bucket_order", "bucket"))
    return grid.join(counts, "bucket", "left").select(
        "bucket", "bucket_order", F.coalesce(F.col("analyses"), F.lit(0)).cast("bigint").alias("analyses"))


def quality_by_category(quality: DataFrame, tickets: DataFrame) -> DataFrame:
    """A20 (+J7): mean confidence (null as 0) and edit rate per ticket category."""
    t = tickets.select(F.col("id").alias("ticket_id"), "category")
    j = quality.select("ticket_id", "confidence", "human_edited").join(t, "ticket_id", "left")
    return j.groupBy(category_or_unclassified().alias("category")).agg(
        F.avg(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("confidence"),
        F.avg(F.col("human_edited").cast("int")).alias("edit_rate"))


def csat(feedback: DataFrame) -> DataFrame:
    """Mean rating, nulls ignored."""
    return feedback.agg(F.avg("rating").alias("csat"), F.count("rating").alias("ratings"))


def bulk_summary(bulk: DataFrame) -> DataFrame:
    """Total / processed / successful / failed rows of a bulk result."""
    failed = F.count_if(F.col("error").isNotNull())
    return bulk.agg(_n().alias("total_rows"), _n().alias("processed_rows"),
                    (_n() - failed).alias("successful_rows"), failed.alias("failed_rows"))


def category_list(tickets: DataFrame) -> DataFrame:
    """Sorted distinct categories with Unclassified for missing."""
    return tickets.select(category_or_unclassified().alias("category")).distinct().orderBy("category")


def doc_inventory(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A24 (+S8): documents with chunk counts and last update date, newest upload first."""
    c = chunks.groupBy("doc_id").agg(_n().alias("chunk_count"))
    j = documents.select("doc_id", "filename", "document_type", "uploaded_at", "indexed_at").join(c, "doc_id", "left")
    return j.select("doc_id", "filename", "document_type", "uploaded_at",
                    F.coalesce(F.col("chunk_count"), F.lit(0)).cast("bigint").alias("chunk_count"),
                    F.to_date(F.coalesce("indexed_at", "uploaded_at")).alias("last_update")) \
        .orderBy(F.col("uploaded_at").desc(), F.col("doc_id").asc())


def brief_facts(risks: DataFrame, quality: DataFrame, categories: DataFrame) -> DataFrame:
    """Narrative sentences from the brief aggregates (one row)."""
    r = risks.agg(_n().alias("risk_count"))
    q = quality.agg(F.struct(_n().alias("analyses"), F.count_if(~F.col("validation_passed")).alias("failures"))
                    .alias("q")).scalar()
    # most common category: highest count, ties by name ascending
    top = categories.agg(F.min_by("category", F.struct((-F.col("tickets")).alias("n"), F.col("category")))
                         .alias("top_category")).scalar()
    j = r.select("risk_count", q["analyses"].alias("analyses"), q["failures"].alias("failures"),
                 top.alias("top_category"))  # scalar subqueries, no join
    return j.select(
        "risk_count", "analyses", "failures", "top_category",
        F.format_string("%d ticket(s) are at risk or past an SLA target.", "risk_count").alias("risk_text"),
        F.format_string("%d ticket analysis record(s) are available.", "analyses").alias("analysis_text"),
        F.format_string("%d recent response validation failure(s).", "failures").alias("failure_text"),
        F.when(F.col("top_category").isNotNull(),
               F.format_string("Most common ticket category: %s.", "top_category")).alias("category_text"),
    )
