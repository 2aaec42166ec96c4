from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.functions.joins import holds_at_most, join_in_force, met_in_slots
from meterwise.operators import versions
from meterwise.sources.driver_tables import load
from meterwise.sources.platform import flat_clusters, flat_prices, flat_usage

CLUSTERS = (
    "cluster_id string, workspace_id string, cluster_name string, cluster_source string, worker_node_type string, "
    "min_workers int, max_workers int, change_time timestamp, delete_time timestamp"
)
USAGE = "cloud string, sku_name string, usage_start_time timestamp, usage_quantity double"
PRICES = "cloud string, sku_name string, price_start_time timestamp, price_end_time timestamp, unit_price double"


@pytest.fixture
def prices(frame):
    return frame(
        [
            ("a", "x", "2024-01-01 00:00:00", "2024-01-15 00:00:00", 1.0),
            ("a", "x", "2024-01-15 00:00:00", None, 2.0),
        ],
        PRICES,
    )


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_price_window_is_half_open(frame, prices, cfg, broadcast_rows):
    usage = frame(
        [
            ("a", "x", "2023-12-31 23:59:59", 1.0),  # before any price
            ("a", "x", "2024-01-01 00:00:00", 10.0),  # exactly at a start
            ("a", "x", "2024-01-14 23:59:59", 10.0),
            ("a", "x", "2024-01-15 00:00:00", 10.0),  # exactly at an end
            ("a", "x", "2030-01-01 00:00:00", 10.0),  # open end
            ("b", "x", "2024-01-02 00:00:00", 10.0),  # no such price
        ],
        USAGE,
    )
    priced = versions.priced_usage(usage, prices, replace(cfg, broadcast_rows=broadcast_rows))
    assert rows_of(priced, F.col("usage_start_time").cast("string"), "cost_usd") == [
        ("2024-01-01 00:00:00", 10.0),
        ("2024-01-14 23:59:59", 10.0),
        ("2024-01-15 00:00:00", 20.0),
        ("2030-01-01 00:00:00", 20.0),
    ]


def test_salted_join_gives_what_broadcast_gives(spark, cfg):
    t = load(spark, "/root/testdata/sf0.001")
    few = versions.priced_usage(t.usage, t.list_prices, cfg)
    many = versions.priced_usage(t.usage, t.list_prices, replace(cfg, broadcast_rows=1))
    assert "_slice" in many._jdf.queryExecution().optimizedPlan().toString()
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    assert few.count() == t.usage.count()


JOIN = (["k"], "at", "since", "until")


def histories(spark, days):
    """A long history for two keys, one version every 12 hours, each with an overlapping twin; all but the last end."""
    start = F.timestamp_add("HOUR", F.col("id") * 12, F.lit("2024-01-01").cast("timestamp"))
    end = F.when(F.col("id") < 2 * days - 1, F.timestamp_add("HOUR", F.lit(12), "since"))
    return (
        spark.range(2 * days).withColumn("since", start).withColumn("until", end)
        .crossJoin(spark.createDataFrame([("hot", 0), ("hot", 1), ("cold", 0)], "k string, twin int"))
        .withColumnRenamed("id", "version")
    )


def test_facts_meet_the_versions_of_their_slot_and_not_a_whole_history(spark, cfg):
    versions_of_days = histories(spark, 60)
    at = F.timestamp_add("MINUTE", F.col("id") * 37, F.lit("2023-12-30").cast("timestamp"))
    facts = spark.range(3000).withColumn("k", F.expr("IF(id % 10 = 0, 'cold', IF(id % 10 = 1, 'other', 'hot'))")).withColumn("at", at)
    facts = facts.withColumn("at", F.expr("CASE WHEN id = 7 THEN null ELSE at END"))
    met = met_in_slots(facts, versions_of_days, *JOIN, cfg)
    plain = facts.join(versions_of_days, "k")
    assert met.count() <= 4 * 2 * facts.count() < plain.count() / 20  # four of a day's bounds, two twins
    for bound in (0, 10_000):
        joined = join_in_force(facts, versions_of_days, *JOIN, replace(cfg, broadcast_rows=bound))
        expected = plain.where("since <= at AND (until IS NULL OR at < until)").drop("since", "until")
        assert joined.exceptAll(expected).isEmpty() and expected.exceptAll(joined).isEmpty()


def test_an_absurd_time_and_no_time_at_all(spark, cfg):
    few = histories(spark, 3)
    facts = spark.createDataFrame([("hot", "2024-01-02 05:00:00"), ("hot", "9999-01-01 00:00:00"), ("hot", "0001-02-01 00:00:00")], "k string, at string")
    facts = facts.withColumn("at", F.col("at").cast("timestamp"))
    joined = join_in_force(facts, few, *JOIN, replace(cfg, broadcast_rows=0))
    assert rows_of(joined, F.col("at").cast("string"), "version", "twin") == [
        ("2024-01-02 05:00:00", 2, 0), ("2024-01-02 05:00:00", 2, 1), ("9999-01-01 00:00:00", 5, 0), ("9999-01-01 00:00:00", 5, 1),
    ]
    for none in (facts.where("false"), facts.withColumn("at", F.lit(None).cast("timestamp"))):
        assert join_in_force(none, few, *JOIN, replace(cfg, broadcast_rows=0)).isEmpty()


def test_salt_spreads_one_hot_key(frame, spark, prices, cfg):
    usage = spark.range(4000).select(
        F.lit("a").alias("cloud"), F.lit("x").alias("sku_name"),
        (F.lit("2024-01-02 00:00:00").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,id)")).alias("usage_start_time"),
        F.lit(1.0).alias("usage_quantity"),
    )
    slices = usage.select(F.pmod(F.xxhash64(*usage.columns), F.lit(cfg.salt_buckets)).alias("s")).groupBy("s").count()
    assert slices.count() == cfg.salt_buckets
    assert slices.agg(F.max("count")).first()[0] < 4000 / cfg.salt_buckets * 2


def test_join_without_window_would_multiply(frame, prices, cfg):
    usage = frame([("a", "x", "2024-01-02 00:00:00", 10.0)], USAGE)
    assert usage.join(prices, ["cloud", "sku_name"]).count() == 2
    assert versions.priced_usage(usage, prices, cfg).count() == 1


def test_size_check_stops_at_the_bound(spark):
    assert holds_at_most(spark.range(10), 10)
    assert not holds_at_most(spark.range(11), 10)


def test_latest_live_and_last_undeleted_differ_for_a_deleted_cluster(frame):
    clusters = frame(
        [
            ("1", "w", "old", "JOB", "n", 1, 2, "2024-01-01 00:00:00", None),
            ("1", "w", "new", "JOB", "n", 1, 2, "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
            ("2", "w", "only", "JOB", "n", 1, 2, "2024-01-01 00:00:00", None),
        ],
        CLUSTERS,
    )
    assert rows_of(versions.latest_clusters(clusters), "cluster_name") == [("new",), ("only",)]
    assert rows_of(versions.live_clusters(clusters), "cluster_name") == [("only",)]
    assert rows_of(versions.last_undeleted_clusters(clusters), "cluster_name") == [("old",), ("only",)]


def test_equal_change_times_give_one_row_and_one_answer(frame):
    rows = [("w", "1", name, "2024-01-01 00:00:00") for name in "abc"]
    schema = "workspace_id string, job_id string, name string, change_time timestamp"
    for order in (rows, rows[::-1]):
        assert rows_of(versions.latest_jobs(frame(order, schema))) == [("w", "1", "c")]


def test_job_without_definition_keeps_a_null_name(frame):
    per_job = frame([("w", "9", 1)], "workspace_id string, job_id string, n int")
    jobs = frame([("w", "1", "a", "2024-01-01 00:00:00")],
                 "workspace_id string, job_id string, name string, change_time timestamp")
    assert rows_of(versions.with_job_name(per_job, jobs), "job_id", "job_name") == [("9", None)]


def test_nested_platform_tables_are_read_flat(spark):
    usage = spark.sql(
        "SELECT 'w' AS workspace_id, named_struct('job_id', '7', 'cluster_id', 'c') AS usage_metadata, "
        "DATE'2024-01-01' AS usage_date, TIMESTAMP'2024-01-01 00:00:00' AS usage_start_time, 's' AS sku_name, "
        "'c' AS cloud, 'JOBS' AS billing_origin_product, map('other', 'x') AS custom_tags, "
        "CAST(1.5 AS DECIMAL(38,18)) AS usage_quantity"
    )
    row = flat_usage(usage).first()
    assert (row["job_id"], row["cluster_id"], row["team_tag"], row["usage_quantity"]) == ("7", "c", None, 1.5)
    prices = spark.sql(
        "SELECT 'c' AS cloud, 's' AS sku_name, TIMESTAMP'2024-01-01 00:00:00' AS price_start_time, "
        "CAST(NULL AS TIMESTAMP) AS price_end_time, named_struct('default', CAST(0.25 AS DECIMAL(38,18))) AS pricing"
    )
    assert flat_prices(prices).first()["unit_price"] == 0.25
    head = "SELECT '1' AS cluster_id, 'w' AS workspace_id, 'n' AS cluster_name, 'UI' AS cluster_source, "
    tail = ", TIMESTAMP'2024-01-01 00:00:00' AS change_time, CAST(NULL AS TIMESTAMP) AS delete_time"
    nested = head + "'t' AS node_type_id, named_struct('min_workers', 1, 'max_workers', 4) AS autoscale" + tail
    flat = head + "'t' AS worker_node_type, 1 AS min_autoscale_workers, 4 AS max_autoscale_workers" + tail
    assert flat_clusters(spark.sql(nested)).collect() == flat_clusters(spark.sql(flat)).collect()
