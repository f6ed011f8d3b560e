"""Plan regression tests: the physical properties the scale design relies on."""

import pytest

import __spark_entry__ as E
from opsdesk.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"
BATCH = [k for k in all_queries() if not k.startswith("st_") and k != "csv_intake"]


def _plan(spark, key: str) -> str:
    return E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_cross_or_nested_loop_joins(spark, key):
    p = _plan(spark, key)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_per_key_top_n_is_limited_before_the_shuffle(spark):
    for key in ("customer_recent", "conversation_tail", "retrieve_cosine", "similar_tickets"):
        p = _plan(spark, key)
        assert "WindowGroupLimit" in p and "Partial" in p, key


def test_retrieval_scores_in_arrow_tasks(spark):
    for key in ("retrieve_cosine", "retrieve_jaccard", "retrieve_dense"):
        p = _plan(spark, key)
        assert "MapInArrow" in p and "CartesianProduct" not in p, key


def test_stored_index_is_read_not_rebuilt(spark):
    p = _plan(spark, "retrieve_cosine")
    assert "documents.parquet" not in p and "index-knowledge" in p      # no chunking or hashing of the corpus


def test_scans_read_only_needed_columns_and_push_filters(spark):
    df = E.queries()["feedback_recent"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in p            # filter reaches the parquet scan
    assert "value:double" not in p                      # unused column pruned from ReadSchema
    k = _plan(spark, "kpi_metrics")
    assert "props:string" in k and "value:double" not in k


def test_latest_per_key_is_an_aggregate_not_a_sort(spark):
    p = _plan(spark, "inbox")
    assert "max_by" in p and "Window" not in p
