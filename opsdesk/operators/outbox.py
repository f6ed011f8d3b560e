"""Approval-gated, idempotent outbound messages (U5, U6, U7, J11, P17-P19, CL10).

Gate order per draft: not approved → blank → channel → ticket missing → unsafe → repeat.
The idempotency key is sha-256 of ``ticket|channel|recipient|subject|content.strip()``.  A
key is rejected when it was recorded before (all-time log, left anti join) or when an
earlier draft in the same batch that passed every other gate has the same key (first by
time, then id — a ``min_by`` aggregate joined back, so a hot key is never sorted in one
task).  A repeat is rejected even if the earlier attempt failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions.time import as_timestamp

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import is_blank, py_strip
from opsdesk.operators.resolve import response_issues
from opsdesk.session import stored


def recipient_for(channel: Column, email: Column, phone: Column) -> Column:
    """Email address for Email, phone for SMS."""
    return F.when(channel == "Email", email).when(channel == "SMS", phone)


def idempotency_key(ticket_id: Column, channel: Column, recipient: Column, subject: Column, content: Column) -> Column:
    parts = [ticket_id.cast("string"), channel, recipient, subject, py_strip(content)]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]), 256)


def stored_evidence(analyses: DataFrame) -> DataFrame:
    """(ticket_id, has_evidence) from the latest stored analysis of every ticket (ticket_id,
    result_json, created_at): a result that is no JSON, or has no evidence, counts as none."""
    found = F.coalesce(F.get_json_object("result_json", "$.evidence[0]").isNotNull(), F.lit(False))
    # only times and flags are shuffled; results themselves only where the latest ones of a ticket disagree
    flags = analyses.select("ticket_id", "created_at", found.alias("has"))
    latest = stored(flags.groupBy("ticket_id", "created_at").agg(F.max(F.col("has").cast("int")).alias("some"),
                                                                F.min(F.col("has").cast("int")).alias("all"))
                    .groupBy("ticket_id").agg(F.max(F.struct("created_at", "some", "all")).alias("m"))
                    .select("ticket_id", (F.col("m.some") == 1).alias("has_evidence"), (F.col("m.some") != F.col("m.all")).alias("unsure")),
                    "stored-evidence")
    sure = latest.where("NOT unsure").select("ticket_id", "has_evidence")
    unsure = latest.where("unsure").select(F.col("ticket_id").alias("id"))
    if unsure.isEmpty():
        return sure
    tied = analyses.join(unsure, F.col("ticket_id").eqNullSafe(F.col("id")), "left_semi")
    last = tied.groupBy("ticket_id").agg(F.max_by("result_json", F.struct("created_at", "result_json")).alias("j"))
    return sure.unionByName(last.select("ticket_id", F.get_json_object("j", "$.evidence[0]").isNotNull().alias("has_evidence")))


def build_outbox(drafts: DataFrame, tickets: DataFrame, customers: DataFrame,
                 evidence: DataFrame | None = None, recorded_keys: DataFrame | None = None) -> DataFrame:
    """Every draft with ``status`` accepted/rejected and the first failing gate's reason.

    ``evidence``: optional (ticket_id, has_evidence) from the latest analysis; without it
    the safety check treats evidence as absent.  ``recorded_keys``: the all-time key log."""
    t = tickets.select(F.col("id").alias("ticket_id"), "customer_id", F.lit(True).alias("_ticket"))
    c = customers.select(F.col("id").alias("customer_id"), "email", "phone")
    d = drafts.join(t, "ticket_id", "left").join(c, "customer_id", "left")
    if evidence is not None:
        d = d.join(evidence.select("ticket_id", "has_evidence"), "ticket_id", "left")
    else:
        d = d.withColumn("has_evidence", F.lit(False))
    recipient = recipient_for(F.col("channel"), F.col("email"), F.col("phone"))
    d = d.withColumn("recipient", recipient).withColumn(
        "idempotency_key", idempotency_key(F.col("ticket_id"), F.col("channel"), F.col("recipient"),
                                           F.col("subject"), F.col("content")))
    issues = response_issues(F.col("content"), F.coalesce(F.col("has_evidence"), F.lit(False)))
    pre = F.when(~F.coalesce(F.col("agent_approved"), F.lit(False)), F.lit(LX.GATE_NOT_APPROVED)) \
        .when(is_blank(F.col("content")), F.lit(LX.GATE_BLANK)) \
        .when(~F.coalesce(F.col("channel").isin(*LX.OUTBOUND_CHANNELS), F.lit(False)), F.lit(LX.GATE_CHANNEL)) \
        .when(F.col("_ticket").isNull(), F.lit(LX.GATE_NO_TICKET)) \
        .when(F.size(issues) > 0, F.concat(F.lit(LX.GATE_UNSAFE), F.array_join(issues, " ")))
    d = d.withColumn("pre_reason", pre)
    passed = d.where(F.col("pre_reason").isNull())
    first = passed.groupBy("idempotency_key").agg(
        F.min_by("draft_id", F.struct("created_at", "draft_id")).alias("first_draft"))
    d = d.join(first, "idempotency_key", "left")
    repeat = F.col("first_draft") != F.col("draft_id")
    if recorded_keys is not None:
        rk = recorded_keys.select("idempotency_key").distinct().withColumn("_recorded", F.lit(True))
        d = d.join(rk, "idempotency_key", "left")
        repeat = repeat | F.col("_recorded").isNotNull()
    reason = F.coalesce(F.col("pre_reason"), F.when(repeat, F.lit(LX.GATE_REPEAT)))
    return d.select("draft_id", "ticket_id", "customer_id", "channel", "recipient", "subject", "content",
                    "idempotency_key", "created_at",
                    F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"),
                    reason.alias("reject_reason"))


def check_deliverable(outbox: DataFrame, email_provider: str = "demo", sms_provider: str = "demo",
                      force_demo: bool = False) -> DataFrame:
    """P17 + P18: provider choice and the live providers' contact rules (the transport itself
    is not built): demo → ``demo_sent``; live and deliverable → ``ready``; else an error."""
    ch = F.col("channel")
    provider = F.lit("demo") if force_demo else \
        F.when(ch == "Email", F.lit(email_provider)).otherwise(F.lit(sms_provider))
    is_demo = provider.isin("demo", "mock", "")
    rec = F.col("recipient")
    email_err = F.when(is_blank(rec), F.lit("SMTP host, sender, username, password, or customer email is incomplete.")) \
        .when(~rec.rlike("^(?:" + LX.EMAIL_PATTERN + ")\\z"),
              F.lit("A valid customer email address is required for SMTP delivery."))
    sms_err = F.when(is_blank(rec), F.lit("SMS gateway settings or customer phone are incomplete.")) \
        .when(~rec.rlike("^(?:" + LX.PHONE_PATTERN + ")\\z"),
              F.lit("A customer phone number in E.164 format is required for SMS.")) \
        .when(F.length(F.col("content")) > LX.SMS_MAX_CHARS,
              F.lit("SMS message exceeds the provider's 1,600-character limit."))
    err = F.when(is_demo, F.lit(None).cast("string")) \
        .when((ch == "Email") & (provider == "smtp"), email_err) \
        .when((ch == "SMS") & (provider == "sms_gateway"), sms_err) \
        .otherwise(F.lit("The configured communication provider is not supported for this channel."))
    return outbox.select(
        "draft_id", "ticket_id", "channel", "recipient", "idempotency_key",
        provider.alias("provider"), F.substring(F.col("subject"), 1, LX.SUBJECT_MAX_CHARS).alias("subject"),
        err.alias("deliver_error"),
        F.when(err.isNotNull(), "failed").when(is_demo, "demo_sent").otherwise("ready").alias("delivery_status"))


def apply_delivery_results(results: DataFrame, as_of) -> dict:
    """Key-log status, outbound message rows, touched tickets and audit events per delivery result.
    Failed deliveries write only the key status and a failure event."""
    stamp = as_timestamp(as_of)
    ok = F.col("delivery_status") != "failed"
    keys = results.select("idempotency_key", "ticket_id", F.col("delivery_status").alias("status"),
                          stamp.alias("created_at"))
    messages = results.where(ok).select(
        "ticket_id", "channel", F.lit("outbound").alias("direction"), F.lit("Support Agent").alias("sender"),
        "idempotency_key", "delivery_status", stamp.alias("created_at"))
    ev = F.when(ok, F.array(
        F.struct(F.lit(LX.EV_RECORDED).alias("event_type"),
                 F.format_string("Approved %s message recorded with status %s.", F.col("channel"),
                                 F.col("delivery_status")).alias("description")),
        F.struct(F.lit(LX.EV_APPROVED).alias("event_type"),
                 F.lit("Agent approved the final customer response.").alias("description")),
        F.struct(F.lit(LX.EV_VALIDATED).alias("event_type"),
                 F.lit("Response validation passed before approval.").alias("description")),
    )).otherwise(F.array(F.struct(
        F.lit(LX.EV_DELIVERY_FAILED).alias("event_type"),
        F.format_string("Approved %s could not be accepted by the configured provider.", F.col("channel"))
        .alias("description"))))
    audit = results.select("ticket_id", "idempotency_key", F.inline(ev))
    tickets = results.where(ok).select("ticket_id").distinct().withColumn("updated_at", stamp)
    return {"keys": keys, "messages": messages, "tickets": tickets, "audit": audit}


def human_edited(latest: DataFrame, sent: DataFrame) -> DataFrame:
    """The latest analysis draft is non-blank and differs from a sent message (trimmed)."""
    j = sent.select("ticket_id", py_strip(F.col("content")).alias("sent")).join(
        latest.select("ticket_id", "analysis_id", py_strip(F.col("draft")).alias("orig")), "ticket_id", "inner")
    edited = (F.length("orig") > 0) & (F.col("orig") != F.col("sent"))
    return j.groupBy("ticket_id", "analysis_id").agg(F.max(edited.cast("int")).cast("boolean").alias("human_edited"))
