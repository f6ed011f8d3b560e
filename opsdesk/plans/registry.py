"""Query registry: one entry per operator key, pairing the Spark plan with its DuckDB oracle.

Spark side: ``run(spark, sf_dir)`` builds the plan over the derived views, rounds every
floating-point output column to 6 decimals and widens integral columns to bigint.  The oracle
side applies the same rounding and casts DuckDB's HUGEINT / INTEGER outputs to BIGINT, so both
results have the same column types.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsdesk.plans.oracle_views import with_views
from opsdesk.sources.views import Views


@dataclass
class Query:
    key: str
    build: Callable[[Views], DataFrame]
    sql: str | None = None
    floats: list[str] = field(default_factory=list)
    doc: str = ""
    ints: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_floats(self.build(Views(spark, sf_dir)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.sql)
        ints = self.ints or WIDEN_COLUMNS.get(self.key, [])
        if not self.floats and not ints:
            return body
        repl = ", ".join([f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in self.floats]
                         + [f"CAST({c} AS BIGINT) AS {c}" for c in ints])
        return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS q"


REGISTRY: dict[str, Query] = {}

# oracle columns widened to BIGINT: DuckDB returns HUGEINT for count_if / sum over integers and
# INTEGER for int literals / int columns, while every Spark integral output is bigint
WIDEN_COLUMNS: dict[str, list[str]] = {
    "kpi_metrics": ["open", "high", "resolved", "escalated_or_critical", "pending_feedback"],
    "brief_counts": ["tickets_today", "open", "high_priority", "escalated"],
    "quality_signal": ["validation_failures", "mcp_failures"],
    "analytics_tiles": ["open", "escalated"],
    "quality_kpis": ["validation_failures"],
    "sla_dashboard": ["sla_risks", "sla_met", "resolved"],
    "brief_facts": ["failures"],
    "hash_embed": ["v", "norm2"],
    "similarity_counts": ["escalations"],
    "feedback_recent": ["rating"],
    "feedback_stars": ["rating"],
    "feedback_validate": ["rating"],
    "retrieve_dense": ["qid"],
    "wf_audit": ["seq"],
    "copilot_context": ["evidence_count"],
    "extract_pages": ["n_chars"],
}


def query(key: str, sql: str | None = None, floats: list[str] | None = None):
    def deco(fn: Callable[[Views], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, list(floats or []), (fn.__doc__ or "").strip())
        return fn
    return deco


def round_floats(df: DataFrame) -> DataFrame:
    """Round floating-point columns to 6 decimals and widen integral columns to bigint."""
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), 6).alias(f.name))
            changed = True
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
            changed = True
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols) if changed else df
