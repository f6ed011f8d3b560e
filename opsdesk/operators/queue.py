"""Queue views: ticket list / search / filters, inbox, conversations, per-key latest rows and
top-k lists (P1-P11, J1, J4, J6, S1-S4, S7, W3-W9, P5, P6).

Per-key "latest" rows use ``max_by`` (partial + final aggregate, no sort).  Per-key top-n uses
``row_number() <= n``, which Spark plans as a partial WindowGroupLimit before the shuffle, so
even a hot key ships at most n rows per map partition.  Full orderings use a global
``orderBy`` (range partitioned) rather than an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.predicates import category_or_unclassified, is_open, priority_rank, ticket_order
from opsdesk.functions.text import preview


def ticket_list(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """P1 + J1 + S1: tickets with customer name/email/phone, priority-then-newest order."""
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                         F.col("email").alias("customer_email"), F.col("phone").alias("customer_phone"))
    j = tickets.join(c, "customer_id", "inner")
    return j.select("*", priority_rank().alias("priority_rank")).orderBy(*ticket_order())


def search_predicate(term: str, *cols: Column) -> Column:
    """Case-insensitive literal substring over any of ``cols``."""
    needle = F.lit(term.lower())
    expr = F.lit(False)
    for c in cols:
        expr = expr | F.coalesce(F.lower(c.cast("string")).contains(needle), F.lit(False))
    return expr


def ticket_search(listing: DataFrame, term: str) -> DataFrame:
    """Search id, subject, customer name, description."""
    if not term:
        return listing
    return listing.where(search_predicate(term, F.col("id"), F.col("subject"), F.col("customer_name"),
                                          F.col("description")))


def ticket_filter(tickets: DataFrame, status: str | None = None, priority: str | None = None,
                  category: str | None = None) -> DataFrame:
    """Status / priority / category filters; None or "All" = no filter; missing or
    empty category matches "Unclassified"."""
    out = tickets
    if status and status != "All":
        out = out.where(F.col("status") == status)
    if priority and priority != "All":
        out = out.where(F.col("priority") == priority)
    if category and category != "All":
        out = out.where(category_or_unclassified() == category)
    return out


def lookup_tickets(tickets: DataFrame, customers: DataFrame, ids: DataFrame) -> DataFrame:
    """P5: tickets for a frame of requested ids (semi join), with customer columns."""
    wanted = ids.select(F.col("ticket_id").alias("id")).distinct()
    t = tickets.join(wanted, "id", "left_semi")
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                         F.col("email").alias("customer_email"), F.col("phone").alias("customer_phone"),
                         "external_customer_id")
    return t.join(c, "customer_id", "inner")


def resolve_lookups(requests: DataFrame, customers: DataFrame, tickets: DataFrame) -> DataFrame:
    """Allow-listed lookups in bulk — one result row per (request_id, tool, key)."""
    c = customers.select(F.col("id").alias("c_key"), F.col("name").alias("customer_name"),
                         "external_customer_id")
    t = tickets.select(F.col("id").alias("t_key"), F.col("subject").alias("ticket_subject"),
                       F.col("status").alias("ticket_status"), F.col("priority").alias("ticket_priority"),
                       F.col("category").alias("ticket_category"))
    r = requests.select("request_id", "tool", "key",
                        F.when(F.col("tool") == "get_customer", F.col("key")).alias("ck"),
                        F.when(F.col("tool") == "get_ticket", F.col("key")).alias("tk"))
    j = r.join(c, r.ck == c.c_key, "left").join(t, r.tk == t.t_key, "left")
    ok = F.when(F.col("tool") == "get_customer", F.col("c_key").isNotNull()) \
        .when(F.col("tool") == "get_ticket", F.col("t_key").isNotNull()).otherwise(F.lit(False))
    error = F.when(F.col("tool") == "get_order_status", F.lit(LX.TOOL_ORDER_UNAVAILABLE)) \
        .when(~F.col("tool").isin(*LX.TOOL_NAMES), F.lit(LX.TOOL_NOT_PERMITTED))
    return j.select("request_id", "tool", "key", ok.alias("ok"), "customer_name", "external_customer_id",
                    "ticket_subject", "ticket_status", "ticket_priority", "ticket_category", error.alias("error"))


def latest_message(messages: DataFrame, direction: str | None = None) -> DataFrame:
    """W3/W4 helper: latest message per ticket by (created_at, id) — a max_by aggregate."""
    m = messages if direction is None else messages.where(F.col("direction") == direction)
    return m.groupBy("ticket_id").agg(
        F.max_by(F.struct("content", "created_at", "id"), F.struct("created_at", "id")).alias("last"))


def inbox(tickets: DataFrame, customers: DataFrame, messages: DataFrame, channel: str | None = None,
          unread_only: bool = True) -> DataFrame:
    """P7 + P8 + W3: inbox rows with the latest inbound message preview (72 chars + … when
    longer), falling back to the description."""
    t = tickets
    if channel:
        t = t.where(F.col("channel") == channel)
    if unread_only:
        t = t.where(is_open())
    last = latest_message(messages, "inbound").select(F.col("ticket_id").alias("id"), "last")
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    j = t.join(last, "id", "left").join(c, "customer_id", "left")
    text = F.coalesce(F.col("last.content"), F.col("description"))
    return j.select(F.col("id").alias("ticket_id"), "channel", "customer_name", "category", "priority",
                    preview(text, 72).alias("preview"), F.col("last.created_at").alias("last_inbound_at"))


def inbox_internal(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """Tickets that already have an outbound reply (left semi join)."""
    replied = messages.where(F.col("direction") == "outbound").select(F.col("ticket_id").alias("id"))
    return tickets.join(replied, "id", "left_semi").select(F.col("id").alias("ticket_id"), "subject", "status",
                                                           "channel")


def conversation_search(tickets: DataFrame, customers: DataFrame, term: str, channel: str | None = None) -> DataFrame:
    """Substring of lower(name + subject + description), no separators, AND channel."""
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    j = tickets.join(c, "customer_id", "inner")
    hay = F.lower(F.concat_ws("", F.col("customer_name"), F.col("subject"), F.col("description")))
    out = j.where(hay.contains(term.lower()))
    if channel:
        out = out.where(F.col("channel") == channel)
    return out.select(F.col("id").alias("ticket_id"), "customer_name", "subject", "channel")


def conversation_list(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """Latest message of either direction per ticket, first 48 chars + … (always)."""
    last = latest_message(messages).select(F.col("ticket_id").alias("id"), "last")
    j = tickets.join(last, "id", "left")
    text = F.coalesce(F.col("last.content"), F.col("description"))
    return j.select(F.col("id").alias("ticket_id"), preview(text, 48, always_ellipsis=True).alias("preview"),
                    F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_minute"))


def last_n(df: DataFrame, key: str, order: list[Column], n: int, rank_name: str = "rank") -> DataFrame:
    """Top-n rows per key (row_number ≤ n → partial WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= n)


def conversation_tail(messages: DataFrame, n: int = 8) -> DataFrame:
    """Last n messages per ticket, reported oldest first (position 1..n)."""
    tail = last_n(messages, "ticket_id", [F.col("created_at").desc(), F.col("id").desc()], n, "back")
    cnt = F.count(F.lit(1)).over(Window.partitionBy("ticket_id"))  # ≤ n rows per ticket here
    return tail.select("ticket_id", F.col("id").alias("message_id"), "direction", "content", "created_at",
                       (cnt - F.col("back") + 1).alias("position"))


def conversation_thread(messages: DataFrame) -> DataFrame:
    """Full thread in time order (global range-partitioned sort; no per-ticket window)."""
    return messages.select("ticket_id", F.col("id").alias("message_id"), "direction", "sender", "content",
                           "created_at").orderBy("ticket_id", "created_at", "message_id")


def customer_messages(messages: DataFrame) -> DataFrame:
    """Every customer's messages with their ticket, newest first per customer."""
    return messages.select("customer_id", "ticket_id", F.col("id").alias("message_id"), "direction", "channel",
                           "created_at").orderBy(F.col("customer_id"), F.col("created_at").desc(),
                                                 F.col("message_id").desc())


def timeline(events: DataFrame) -> DataFrame:
    """Timeline newest first with a title-cased event label."""
    return events.select("ticket_id", "id", "event_type",
                         F.initcap(F.replace(F.col("event_type"), F.lit("_"), F.lit(" "))).alias("title"),
                         "created_at").orderBy(F.col("ticket_id"), F.col("created_at").desc(), F.col("id").desc())


def top_tickets(tickets: DataFrame, n: int = 5, open_only: bool = False) -> DataFrame:
    """First n tickets in S1 order (TakeOrderedAndProject), with their rank."""
    t = tickets.where(is_open()) if open_only else tickets
    top = t.select("id", "subject", "priority", "status", "created_at").orderBy(*ticket_order()).limit(n)
    w = Window.orderBy(*ticket_order())  # over ≤ n rows
    return top.withColumn("rank", F.row_number().over(w))


def customer_recent(tickets: DataFrame, n: int = 5) -> DataFrame:
    """N most recent tickets per customer in S1 order."""
    w = Window.partitionBy("customer_id").orderBy(*ticket_order())
    return tickets.select("customer_id", "id", "subject", "priority", "created_at") \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def running_number(df: DataFrame, key: str, order: list[Column], name: str = "n",
                   partitions: int | None = None) -> DataFrame:
    """Exact 1..n numbering of each ``key``'s rows in ``order`` without putting a key's rows
    into one task (a single key may hold a large share of all rows).

    1. range-partition by (key, order): a hot key is split over several ranges;
    2. the range id is fixed by a reliable checkpoint (shared checkpoint folder) so both
       branches below see the same assignment, also after an executor loss;
    3. local number within (range, key) — groups are at most one range;
    4. offset = rows of the same key in earlier ranges (a running sum over ≤ #ranges rows)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(key), *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)))
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    return local.join(offsets.drop("_cnt"), [key, "_range"], "inner") \
        .withColumn(name, F.col("_offset") + F.col("_local")).drop("_range", "_local", "_offset")


def sentiment_sequence(tickets: DataFrame) -> DataFrame:
    """Running number per customer over tickets with a sentiment, in S1 order (not by time)."""
    t = tickets.where(F.col("sentiment").isNotNull()).select("customer_id", "id", "sentiment", "priority",
                                                               "created_at")
    numbered = running_number(t, "customer_id", ticket_order(), "ticket_number")
    return numbered.select("customer_id", F.col("id").alias("ticket_id"), "sentiment",
                           F.col("ticket_number").cast("int").alias("ticket_number"))


def feedback_recent(feedback: DataFrame, n: int = 40) -> DataFrame:
    """Latest n feedback rows with their rank."""
    top = feedback.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).limit(n)
    w = Window.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc())  # over ≤ n rows
    return top.withColumn("rank", F.row_number().over(w))


def feedback_split(feedback: DataFrame) -> DataFrame:
    """Feature requests / bug reports by lower-case substring of the type."""
    t = F.lower(F.col("feedback_type"))
    return feedback.select("feedback_id", "feedback_type",
                           F.when(t.contains("feature"), "feature").when(t.contains("bug"), "bug")
                           .otherwise("other").alias("group"))


def feedback_stars(feedback: DataFrame) -> DataFrame:
    """'★' × rating + '☆' × (5 − rating) for rated rows."""
    r = F.col("rating")
    return feedback.where(r.isNotNull()).select(
        "feedback_id", "rating", F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), 5 - r)).alias("stars"))


def doc_search(documents: DataFrame, term: str) -> DataFrame:
    """P10: case-insensitive substring of the file name."""
    return documents.where(F.lower(F.col("filename")).contains(term.lower())).select("doc_id", "filename",
                                                                                      "document_type")
