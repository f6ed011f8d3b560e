"""Derived support-domain views over the shared test tables (FIXTURES.md §C).

Each view is a lazy DataFrame built from the scans in ``tables``; Catalyst fuses the
projections into the scan stage, so a view costs nothing until a query uses a column.
Small literal lookups (phrases, policies) are array/struct literals indexed by position —
a projection, not a join.  The same definitions exist as SQL CTEs in ``plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdesk.sources.tables import load

AS_OF = "2024-01-31 00:00:00"

# FIXED VALUES — fixture phrase list (pid, subject, message, expected category, expected sentiment)
PHRASES = [
    (0, "Card charged twice", "I was charged 49.00 and the plan is still inactive", "Billing", "Negative"),
    (1, "Payment pending", "My payment has not cleared yet", "Billing", "Neutral"),
    (2, "Invoice copy", "Please send invoice 1042 with reference AB12", "Billing", "Neutral"),
    (3, "Password help", "The reset link expired", "Account Access", "Neutral"),
    (4, "Locked out", "I am locked out and cannot sign in", "Account Access", "Negative"),
    (5, "Export problem", "The export failed with an error", "Technical", "Negative"),
    (6, "App crash", "The app will crash on start", "Technical", "Negative"),
    (7, "Small bug", "A bug in the date picker", "Technical", "Neutral"),
    (8, "New idea", "I suggest a dark mode", "Feedback", "Neutral"),
    (9, "Feature ask", "A feature for shortcuts would be helpful", "Feedback", "Neutral"),
    (10, "Question", "Where do I find the user guide", "General Support", "Neutral"),
    (11, "Fraud report", "I see fraud on a duplicate charge", "Billing", "Neutral"),
]

# FIXED VALUES — fixture SLA policies (id, name, first_response_minutes, resolution_minutes, active, created_at)
POLICIES = [
    (1, "old", 60, 2880, False, "2023-12-01 00:00:00"),
    (2, "current", 60, 2880, True, "2023-12-02 00:00:00"),
    (3, "later", 30, 1440, True, "2023-12-03 00:00:00"),
]

# FIXED VALUES — fixture draft texts, chosen by ticket id % 5
DRAFT_TEXTS = [
    "Thanks for reaching out. We have reviewed your account and will follow up shortly.",
    "Your refund is guaranteed and will arrive within two days.",
    "We updated the card 4111111111111111 on your account today.",
    "Thanks!!!!",
    "Thanks for reaching out. We have reviewed your account and will follow up shortly.",
]

# FIXED VALUES — fixture model predictions, chosen by (ticket id / 3) % 6
PREDICTION_TEXTS = [
    '{"category": "Billing", "subcategory": "Refund", "intent": "Refund request", "priority": "High", '
    '"severity": "Major", "sentiment": "Negative", "customer_impact": "Customer charged twice", '
    '"key_information": ["charge"], "missing_information": [], "urgency_reason": "Repeat charge", '
    '"confidence": 0.91, "uncertainty_flags": []}',
    '{"category": "Technical", "priority": " URGENT ", "severity": "critical", "sentiment": "Very Negative", '
    '"confidence": 0.8}',
    '{"category": "Billing", "priority": "P1", "severity": "Major", "sentiment": "Neutral"}',
    '{"category": "Account Access", "priority": "low", "severity": "minor", "sentiment": "neutral", '
    '"confidence": 1.7}',
    '{"category": "Billing", "priority": "High", "severity": "Major", "sentiment": "Negative", '
    '"key_information": [1, 2]}',
    '{"category": "Billing", "priority": ',
]

STATUS_CYCLE = ["Open", "In Progress", "Pending", "Escalated", "Resolved", "Closed", "Reopened"]
FEEDBACK_TYPES = ["Feature request", "Bug report", "General feedback"]


def _pick(values: list, index: Column) -> Column:
    """Literal lookup by a 0-based index (a projection — no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _channel(idx: Column) -> Column:
    return _pick(["Email", "SMS", "Web"], idx % 3)


def add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def prop_k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("int")


def tickets_from(events: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Tickets derived from events: phrase by event_id % 12, whole text of the benchmark item whose id is
    event_id modulo the span of ids (0 .. largest), so every item occurs and no numbering is needed; an
    id without an item adds no text and loses no ticket.  Works for batch and streaming ``events``
    (stream-static join with ``benchmark``)."""
    phrase = F.element_at(
        F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(m).alias("message"), F.lit(c).alias("category"),
                           F.lit(se).alias("sentiment")) for _, s, m, c, se in PHRASES]),
        (F.col("event_id") % 12 + 1).cast("int"))
    k = F.col("k")
    ev = events.select("event_id", "ts", "user_id", prop_k().alias("k"), phrase.alias("p"))
    bench = benchmark.select("item_id", F.col("text").alias("btext"))  # the whole benchmark text
    span = benchmark.agg(F.greatest(F.lit(1).cast("bigint"), F.max("item_id") + 1)).scalar()
    j = ev.join(bench, F.pmod(ev.event_id, span) == bench.item_id, "left")
    status = (F.when(k % 20 == 0, "Escalated").when(k % 20 == 1, "Pending").when(k % 20 == 2, "In Progress")
              .when(k % 20 == 3, "Closed").when(k % 3 == 0, "Open").otherwise("Resolved"))
    priority = (F.when(k % 10 == 0, "Urgent").when((k % 10).isin(1, 2), "High")
                .when((k % 10).isin(3, 4, 5), "Medium").otherwise("Low"))
    severity = (F.when(priority == "Urgent", "Critical").when(priority == "High", "Major")
                .when(priority == "Medium", "Moderate").otherwise("Minor"))
    return j.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("customer_id"),
        F.col("p.subject").alias("subject"),
        F.concat(F.col("p.message"), F.lit(". "), F.coalesce(F.col("btext"), F.lit(""))).alias("description"),
        _channel(F.col("event_id")).alias("channel"),
        status.alias("status"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p.category")).alias("category"),
        priority.alias("priority"),
        severity.alias("severity"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("p.sentiment")).alias("sentiment"),
        F.col("ts").alias("created_at"),
        k.alias("k"),
    )


def audit_from(events: DataFrame) -> DataFrame:
    """Audit events derived from events (batch or streaming)."""
    k = prop_k()
    return events.select(
        F.col("event_id").alias("id"),
        F.when(k % 9 == 0, F.lit(None).cast("bigint")).otherwise(F.col("event_id")).alias("ticket_id"),
        F.col("event_type"),
        F.lit("system").alias("actor_type"),
        F.concat(F.lit("Recorded "), F.col("event_type"), F.lit(" event.")).alias("description"),
        F.col("ts").alias("created_at"),
    )


def drafts_from(tickets: DataFrame) -> DataFrame:
    """Outbound drafts: one per ticket, a second identical one when id % 5 = 4."""
    t = tickets.select("id", "channel", "created_at")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 5 == 4, 2).otherwise(1)))
    return t.select("*", copies.alias("seq")).select(
        (F.col("id") * 10 + F.col("seq")).alias("draft_id"),
        F.col("id").alias("ticket_id"),
        F.col("seq").alias("review_round"),
        _pick(DRAFT_TEXTS, F.col("id") % 5).alias("content"),
        F.col("channel"),
        F.lit("Support update").alias("subject"),
        (F.col("id") % 6 != 0).alias("agent_approved"),
        F.timestamp_add("HOUR", F.col("seq") + 1, F.col("created_at")).alias("created_at"),
    )


def requests_from(customer: DataFrame) -> DataFrame:
    """Support requests derived from customers (batch or streaming)."""
    c = F.col("c_custkey")
    phrase = F.element_at(
        F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(m).alias("message")) for _, s, m, _, _ in PHRASES]),
        (c % 12 + 1).cast("int"))
    return customer.select(
        c.alias("request_id"),
        F.when(c % 13 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(c % 5 == 0, F.lit("")).when(c % 7 == 0, F.lit("bad@@x"))
         .otherwise(F.concat(F.lit("user"), (c % 50).cast("string"), F.lit("@new.test"))).alias("email"),
        phrase.getField("subject").alias("subject"),
        phrase.getField("message").alias("description"),
        _channel(c).alias("channel"),
        F.concat(F.lit("+1555"), F.lpad(c.cast("string"), 7, "0")).alias("phone"),
        F.timestamp_add("SECOND", c, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("requested_at"),
    )


class Views:
    """Lazily built derived views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    VIEW_NAMES = ("tickets", "customers", "messages", "ticket_sla", "sla_policies", "audit_events", "knowledge",
                  "queries", "quality", "feedback", "requests", "drafts", "predictions", "status_changes",
                  "analyses")

    def register(self, prefix: str = "") -> list[str]:
        """Register every derived view as a temp view (lazy), for ``spark.sql`` users."""
        names = []
        for name in self.VIEW_NAMES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    # ------------------------------------------------------------------ core entities
    @cached_property
    def tickets(self) -> DataFrame:
        return tickets_from(self.table("events"), self.table("benchmark"))

    @cached_property
    def customers(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("id"),
            F.concat(F.lit("EXT-"), c.cast("string")).alias("external_customer_id"),
            F.col("c_name").alias("name"),
            F.when(c % 5 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("user"), c.cast("string"), F.lit("@example.test"))).alias("email"),
            F.concat(F.lit("+1555"), F.lpad(c.cast("string"), 7, "0")).alias("phone"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        conv = self.table("conversations").where(F.col("role") != "system")
        t = self.tickets.select(F.col("id").alias("t_id"), F.col("customer_id"), F.col("channel"),
                                F.col("created_at").alias("t_created"))
        j = conv.join(t, conv.conv_id == t.t_id, "inner")
        outbound = F.col("role") == "assistant"
        return j.select(
            (F.col("conv_id") * 10 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("ticket_id"),
            F.col("customer_id"),
            F.col("channel"),
            F.when(outbound, "outbound").otherwise("inbound").alias("direction"),
            F.when(outbound, "agent").otherwise("customer").alias("sender"),
            F.col("text").alias("content"),
            F.when(outbound, "demo_sent").otherwise("received").alias("delivery_status"),
            add_minutes(F.col("t_created"), F.col("turn") * 37).alias("created_at"),
        )

    @cached_property
    def ticket_sla(self) -> DataFrame:
        k = F.col("k")
        return self.tickets.where(F.col("id") % 10 != 0).select(
            F.col("id").alias("ticket_id"),
            F.lit(2).cast("bigint").alias("policy_id"),
            F.when(k % 13 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(add_minutes(F.col("created_at"), F.lit(60))).alias("first_response_due_at"),
            add_minutes(F.col("created_at"), 1440 * (1 + k % 40)).alias("resolution_due_at"),
            F.lit("on_track").alias("first_response_status"),
            F.lit("on_track").alias("resolution_status"),
        )

    @cached_property
    def sla_policies(self) -> DataFrame:
        rows = [F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n).alias("name"),
                         F.lit(fr).cast("int").alias("first_response_minutes"),
                         F.lit(rm).cast("int").alias("resolution_minutes"), F.lit(a).alias("active"),
                         F.lit(ts).cast("timestamp_ntz").alias("created_at")) for i, n, fr, rm, a, ts in POLICIES]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    @cached_property
    def audit_events(self) -> DataFrame:
        return audit_from(self.table("events"))

    # ------------------------------------------------------------------ knowledge
    @cached_property
    def knowledge(self) -> DataFrame:
        d = F.col("doc_id")
        uploaded = add_minutes(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), d)
        return self.table("documents").select(
            d.alias("doc_id"),
            F.concat(F.col("source"), F.lit("/"), d.cast("string"), F.lit(".txt")).alias("filename"),
            F.col("lang").alias("document_type"),
            F.col("text"),
            uploaded.alias("uploaded_at"),
            F.when(d % 4 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(add_minutes(uploaded, F.lit(5))).alias("indexed_at"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text"))

    # ------------------------------------------------------------------ quality / feedback
    @cached_property
    def quality(self) -> DataFrame:
        lab = self.table("labels")
        t = self.tickets.select(F.col("id"), F.col("created_at"))
        j = lab.join(t, lab.doc_id == t.id, "inner")
        d = F.col("doc_id")
        mcp_used = d % 3 == 0
        return j.select(
            d.alias("id"), d.alias("ticket_id"), d.alias("analysis_id"),
            F.when(d % 17 == 0, F.lit(None).cast("double"))
             .otherwise((d % 101).cast("double") / F.lit(100.0)).alias("confidence"),
            (F.col("quality") == 1).alias("validation_passed"),
            (F.col("toxic") == 1).alias("human_edited"),
            (d % 7 == 0).alias("regenerated"),
            (d % 5 != 0).alias("rag_evidence_available"),
            mcp_used.alias("mcp_used"),
            (mcp_used & (d % 2 == 0)).alias("mcp_succeeded"),
            F.col("created_at"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        k = F.col("k")
        ev = self.table("events").where(F.col("event_type") == "signup").withColumn("k", prop_k())
        return ev.select(
            F.col("event_id").alias("feedback_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"),
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.test")).alias("email"),
            F.when(k % 6 == 0, F.lit(None).cast("int")).otherwise(k % 6).alias("rating"),
            _pick(FEEDBACK_TYPES, k % 3).alias("feedback_type"),
            F.concat(F.lit("Signup feedback "), F.col("event_id").cast("string")).alias("message"),
            F.when(k % 4 != 0, "New").otherwise("Reviewed").alias("status"),
            F.col("ts").alias("created_at"),
        )

    # ------------------------------------------------------------------ batch inputs
    @cached_property
    def requests(self) -> DataFrame:
        return requests_from(self.table("customer"))

    @cached_property
    def drafts(self) -> DataFrame:
        return drafts_from(self.tickets)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.tickets.where(F.col("id") % 3 == 0).select(
            F.col("id").alias("ticket_id"),
            _pick(PREDICTION_TEXTS, F.floor(F.col("id") / 3) % 6).alias("raw_json"),
        )

    @cached_property
    def status_changes(self) -> DataFrame:
        ev = self.table("events").where(F.col("event_type") == "click").withColumn("k", prop_k())
        seq = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)))
        ev = ev.select("event_id", "ts", "k", seq.alias("seq"))
        return ev.select(
            (F.col("event_id") * 10 + F.col("seq")).alias("change_id"),
            F.col("event_id").alias("ticket_id"),
            _pick(STATUS_CYCLE, (F.col("k") + 3 * (F.col("seq") - 1)) % 7).alias("status"),
            F.timestamp_add("DAY", F.col("seq"), F.col("ts")).alias("changed_at"),
        )

    @cached_property
    def analyses(self) -> DataFrame:
        """Stored analyses: one per assistant turn of a ticket's conversation (latest wins)."""
        m = self.messages.where(F.col("direction") == "outbound")
        return m.select(
            F.col("id").alias("analysis_id"),
            F.col("ticket_id"),
            F.col("content").alias("draft"),
            F.col("created_at"),
        )
