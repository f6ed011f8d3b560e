"""Spark results and oracle results have identical column names and types."""

import __spark_entry__ as E
from opsdesk.plans.catalog import all_queries
from opsdesk.plans.compare import duckdb_con

SF = "/root/testdata/sf0.001"
DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
        "timestamp_ntz": "TIMESTAMP"}


def test_result_types_match_oracle(spark):
    con = duckdb_con(SF)
    q, sql = E.queries(), {k: s for k, s in E.oracle_sql().items() if k in all_queries()}
    bad = {}
    for key, stmt in sql.items():
        st = {f.name: f.dataType.simpleString() for f in q[key](spark, SF).schema.fields}
        dt = {r[0]: r[1] for r in con.execute("DESCRIBE " + stmt).fetchall()}
        diff = [(c, st[c], dt.get(c)) for c in st if DUCK.get(st[c], st[c]) != dt.get(c)]
        if diff or set(st) != set(dt):
            bad[key] = diff
    assert not bad, bad
