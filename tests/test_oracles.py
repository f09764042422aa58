"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

from oracle import compare, connect
from panelkit.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) == []


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if not n.startswith(("stream_", "kept_"))))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_wide_compare_is_one_shuffle(spark):
    assert _plan(spark, "wide_compare_left").count("Exchange hashpartitioning") == 1


def test_feed_is_a_top_n(spark):
    plan = _plan(spark, "recent_feed")
    assert "TakeOrderedAndProject" in plan and "Exchange hash" not in plan
    assert "PushedFilters: [In(event_type" in plan


def test_scan_reads_needed_columns_only(spark):
    plan = _plan(spark, "share_by_group")
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in plan
