"""Shared ticket predicates and small categorical Columns (P12, P13, P4, S1 keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsdesk.functions.lexicon import CLOSED_STATUSES, KPI_OPEN_STATUSES


def is_open(status: str = "status") -> Column:
    """Not Resolved/Closed (Escalated counts as open)."""
    return ~F.col(status).isin(*CLOSED_STATUSES)


def is_closed(status: str = "status") -> Column:
    return F.col(status).isin(*CLOSED_STATUSES)


def is_kpi_open(status: str = "status") -> Column:
    """Open / In Progress / Pending (Escalated excluded)."""
    return F.col(status).isin(*KPI_OPEN_STATUSES)


def is_high(priority: str = "priority") -> Column:
    return F.col(priority).isin("High", "Urgent")


def category_or_unclassified(category: str = "category") -> Column:
    """Missing or empty category is 'Unclassified'."""
    return F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("Unclassified"))


def priority_rank(priority: str = "priority") -> Column:
    """S1 first key: Urgent 0, High 1, anything else 2."""
    return F.when(F.col(priority) == "Urgent", 0).when(F.col(priority) == "High", 1).otherwise(2)


def ticket_order(prefix: str = "") -> list[Column]:
    """Priority rank, newest first, id as the unique tie-break."""
    return [priority_rank(prefix + "priority").asc(), F.col(prefix + "created_at").desc(), F.col(prefix + "id").asc()]
