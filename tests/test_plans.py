"""Properties of the plans that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUERIES = driver.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plans(df):
    execution = df._jdf.queryExecution()
    return execution.optimizedPlan().toString(), execution.executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_query_pairs_rows_without_a_key(spark, name):
    _, physical = plans(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in physical
    assert "BroadcastNestedLoopJoin" not in physical


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("cost_by_sku", "l_orderkey,l_suppkey,l_linenumber,l_quantity,l_returnflag,l_linestatus"),
        ("cluster_hourly_utilization", "event_id,ts,user_id,value"),
        ("job_health", "o_orderkey,o_custkey,o_totalprice"),
        ("monthly_digest", "c_custkey,c_acctbal"),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    _, physical = plans(QUERIES[name](spark, FOLDER))
    scans = [line for line in physical.splitlines() if "FileScan parquet [" in line]
    read = [line.split("FileScan parquet [")[1].split("]")[0] for line in scans]
    assert columns in [re.sub(r"#\d+L?", "", r) for r in read]


def test_time_bounds_reach_the_scan(spark):
    _, physical = plans(QUERIES["cluster_hourly_utilization"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-01" in physical


def test_causes_read_each_source_once_and_move_only_spiking_jobs(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, physical = plans(QUERIES["spike_explanations"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(re.findall(r"/(\w+)\.parquet\]", physical)) == ["lineitem", "orders", "part"]
    assert physical.count("LeftSemi, BuildRight") == 2
    assert "SortMergeJoin [workspace_id" in physical


def test_health_aggregates_by_hash(spark):
    _, physical = plans(QUERIES["job_health"](spark, FOLDER))
    assert "SortAggregate" not in physical


def test_newest_versions_are_limited_before_the_shuffle(spark):
    _, physical = plans(QUERIES["latest_clusters"](spark, FOLDER))
    partial = physical.index("Partial")
    assert "WindowGroupLimit" in physical and physical.index("Exchange hashpartitioning") < partial


def test_usage_is_not_shuffled_to_meet_prices(spark):
    _, physical = plans(QUERIES["cost_by_sku"](spark, FOLDER))
    assert "BroadcastHashJoin [cloud" in physical and "SortMergeJoin" not in physical
