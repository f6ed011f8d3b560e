"""Order-insensitive result comparison used by the oracle check script and the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def duckdb_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(sdf, con, sql: str) -> tuple[bool, str]:
    scols = sdf.columns
    a = rows_of(scols, [tuple(r) for r in sdf.collect()])
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    if sorted(scols) != sorted(dcols):
        return False, f"columns spark={sorted(scols)} duckdb={sorted(dcols)}"
    b = rows_of(dcols, cur.fetchall())
    if a == b:
        return True, f"rows={len(a)}"
    return False, f"rows spark={len(a)} duckdb={len(b)}; spark-only={list(set(a) - set(b))[:2]}; " \
                  f"duckdb-only={list(set(b) - set(a))[:2]}"
