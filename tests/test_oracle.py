"""Every registered query against its DuckDB oracle on sf0.001; entry() smoke."""

import pytest

import __spark_entry__ as E
from opsdesk.plans.catalog import all_queries
from opsdesk.plans.compare import compare, duckdb_con

SF = "/root/testdata/sf0.001"
SQL = {key: sql for key, sql in E.oracle_sql().items() if key in all_queries()}


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"category", "bucket", "bucket_order", "tickets", "share"}


def test_every_query_has_docs_and_most_have_oracle():
    missing = sorted(set(all_queries()) - set(SQL))
    assert missing == []


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(E.queries()[key](spark, SF), con, SQL[key])
    assert ok, msg
