"""Explicit ``as_of`` handling: every time-dependent operator takes its clock as a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(as_of) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ Column: accepts a Column, an ISO string or a datetime
    (naive = UTC; aware values are converted to UTC).  Datetimes go through ISO text so the
    Python process time zone never matters."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    elif isinstance(as_of, dt.date):
        as_of = as_of.isoformat()
    return F.lit(str(as_of)).cast("timestamp_ntz")
