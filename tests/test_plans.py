"""Plan-level checks on every registered query: no all-pairs joins, scans pruned."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_all_pairs_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_scan_is_pruned_and_filtered(spark):
    plan = _plan(E.queries()["review_window"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_top_k_uses_group_limit(spark):
    plan = E.queries()["newest_n"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_results_do_not_depend_on_partitioning(spark):
    q = E.queries()["top_theme_words"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, q(spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(tuple, q(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
