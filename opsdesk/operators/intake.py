"""Request validation, customer resolution and ticket intake (P14, P15, J9, U3, CL13).

Sequential semantics of one-at-a-time intake are reproduced in batch:
* validation first — rejected requests create nothing;
* a non-blank email matches an existing customer by ``lower(email)`` (existing customers
  de-duplicated by lowest id); otherwise the *first* valid request with that email (by
  time, then id) creates the customer and every later request shares it;
* a blank email always creates a new customer.
Ids are deterministic (``sha2`` of the request id) so a re-run is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import is_blank, py_strip
from opsdesk.operators import sla as SLA


def email_ok(email: Column) -> Column:
    """Blank, or a full match of the address pattern."""
    return is_blank(email) | F.coalesce(email.rlike("^(?:" + LX.EMAIL_PATTERN + ")\\z"), F.lit(False))


def validate_requests(requests: DataFrame) -> DataFrame:
    """``error`` = first failing rule (required fields, then email); ``valid`` flag."""
    err = F.when(is_blank(F.col("name")) | is_blank(F.col("subject")) | is_blank(F.col("description")),
                 F.lit(LX.ERR_REQUIRED)) \
        .when(~email_ok(F.col("email")), F.lit(LX.ERR_EMAIL))
    return requests.withColumn("error", err).withColumn("valid", F.col("error").isNull())


def validate_feedback(feedback: DataFrame) -> DataFrame:
    """Message required; rating null or 1..5; email blank or valid.  Valid rows are
    trimmed, blanks become null and status is 'New'."""
    r = F.col("rating")
    err = F.when(is_blank(F.col("message")) | (r.isNotNull() & ~r.between(1, 5)), F.lit(LX.ERR_FEEDBACK)) \
        .when(~email_ok(F.col("email")), F.lit(LX.ERR_FEEDBACK_EMAIL))

    def clean(c):
        return F.when(is_blank(F.col(c)), F.lit(None)).otherwise(py_strip(F.col(c)))

    return feedback.select(
        "feedback_id", clean("name").alias("name"), clean("email").alias("email"), "rating", "feedback_type",
        py_strip(F.col("message")).alias("message"), F.lit("New").alias("status"), err.alias("error"),
        err.isNull().alias("valid"))


def resolve_customers(valid_requests: DataFrame, customers: DataFrame) -> DataFrame:
    """(request_id, customer_id, is_new) for valid requests."""
    r = valid_requests.select("request_id", "requested_at", F.lower(py_strip(F.col("email"))).alias("em"),
                              is_blank(F.col("email")).alias("blank_email"))
    existing = customers.where(~is_blank(F.col("email"))).groupBy(F.lower(py_strip(F.col("email"))).alias("em")) \
        .agg(F.min("id").alias("existing_id"))
    first = r.where(~F.col("blank_email")).groupBy("em").agg(
        F.min_by("request_id", F.struct("requested_at", "request_id")).alias("first_request"))
    j = r.join(existing, "em", "left").join(first, "em", "left")
    new_id = F.concat(F.lit("CUS-"), F.substring(F.sha2(F.concat(F.lit("customer:"),
                      F.when(F.col("blank_email"), F.col("request_id")).otherwise(F.col("first_request"))
                      .cast("string")), 256), 1, 32))
    return j.select("request_id",
                    F.coalesce(F.col("existing_id").cast("string"), new_id).alias("customer_id"),
                    (F.col("existing_id").isNull() & (F.col("blank_email") |
                                                      (F.col("first_request") == F.col("request_id"))))
                    .alias("creates_customer"))


def intake(requests: DataFrame, customers: DataFrame, policies: DataFrame) -> dict:
    """Tickets (Open / Medium / Moderate / Unassigned, trimmed), first inbound message,
    SLA rows from the oldest active policy, new customers, rejects."""
    v = validate_requests(requests)
    ok = v.where(F.col("valid"))
    cust = resolve_customers(ok, customers)
    r = ok.join(cust, "request_id", "inner")
    tid = F.concat(F.lit("SUP-"), F.upper(F.substring(F.sha2(F.concat(F.lit("ticket:"),
                                                                        F.col("request_id").cast("string")), 256), 1, 32)))
    tickets = r.select(
        tid.alias("id"), "request_id", "customer_id", py_strip(F.col("subject")).alias("subject"),
        py_strip(F.col("description")).alias("description"), "channel", F.lit("Open").alias("status"),
        F.lit("Medium").alias("priority"), F.lit("Moderate").alias("severity"),
        F.lit(LX.DEFAULT_AGENT).alias("assigned_agent"), F.col("requested_at").alias("created_at"))
    senders = r.select("request_id", py_strip(F.col("name")).alias("sender"))
    messages = tickets.join(senders, "request_id", "inner").select(
        F.col("id").alias("ticket_id"), "customer_id", "channel", F.lit("inbound").alias("direction"), "sender",
        F.col("description").alias("content"), F.lit("received").alias("delivery_status"), "created_at")
    sla = SLA.sla_assign(tickets, policies)
    new_customers = r.where(F.col("creates_customer")).select(
        F.col("customer_id").alias("id"), py_strip(F.col("name")).alias("name"),
        F.when(is_blank(F.col("email")), F.lit(None)).otherwise(py_strip(F.col("email"))).alias("email"),
        F.when(is_blank(F.col("phone")), F.lit(None)).otherwise(py_strip(F.col("phone"))).alias("phone"),
        F.col("requested_at").alias("created_at"))
    rejected = v.where(~F.col("valid")).select("request_id", "error")
    return {"tickets": tickets, "messages": messages, "ticket_sla": sla, "customers": new_customers,
            "rejected": rejected}


def bulk_analyze(rows: DataFrame, knowledge, k: int = LX.K_BULK, max_rows: int | None = None,
                 key: str = "row_id", observation=None) -> DataFrame:
    """CL13: per-row classification of a CSV batch in one pass.

    The whole stripped subject and description are classified; a missing or blank value gives a
    failed row with a fixed error (the row text is never echoed).
    ``knowledge_matches`` and ``knowledge_sources`` are the k best hits of "subject description" in
    ``knowledge`` (a ``VectorIndex`` or ``ChunkCorpus``), retrieved once per distinct text.  ``max_rows`` reproduces
    the optional batch cap (raise when exceeded); at scale it is left unset.  Progress is
    reported through Spark's own metrics: pass a ``pyspark.sql.Observation`` and read
    ``processed`` / ``failed`` from it after the action (no driver-side callback per row)."""
    from opsdesk.operators.classify import with_rule_analysis

    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"Batch exceeds the {max_rows:,}-row limit. Split the CSV and retry.")
    subj, desc = py_strip(F.col("subject")), py_strip(F.col("description"))
    r = rows.select(key, subj.alias("s"), desc.alias("d"),
                    F.coalesce(F.col("customer").cast("string"), F.lit("")).alias("customer"),
                    F.xxhash64(F.concat_ws(" ", subj, desc)).alias("th"))
    ok = F.col("s").isNotNull() & F.col("d").isNotNull() & (F.length("s") > 0) & (F.length("d") > 0)
    r = r.withColumn("ok", ok)
    asked = r.where("ok").groupBy("th").agg(F.any_value(F.concat_ws(" ", "s", "d")).alias("text"))
    hits = knowledge.retrieve(asked, k, "th").groupBy("th").agg(
        F.sort_array(F.collect_list(F.struct("rank", "filename"))).alias("hits"))
    out = with_rule_analysis(r, "s", "d").join(hits, "th", "left")

    def when_ok(c):
        return F.when(F.col("ok"), c)

    result = out.select(
        key, F.when(F.col("ok"), F.col("s")).otherwise(F.lit(LX.BULK_FAILED_SUBJECT)).alias("subject"),
        when_ok(F.col("customer")).alias("customer"),
        *[when_ok(F.col(c)).alias(c) for c in ("category", "intent", "priority", "severity", "sentiment",
                                               "confidence")],
        when_ok(F.coalesce(F.size("hits"), F.lit(0)).cast("bigint")).alias("knowledge_matches"),
        when_ok(F.array_join(F.col("hits.filename"), " | ")).alias("knowledge_sources"),
        when_ok(F.lit("rules")).alias("analysis_mode"),
        F.when(~F.col("ok"), F.lit(LX.BULK_ERR_TEXT)).alias("error"))
    if observation is not None:
        result = result.observe(observation, F.count(F.lit(1)).alias("processed"),
                                F.count_if(F.col("error").isNotNull()).alias("failed"))
    return result
