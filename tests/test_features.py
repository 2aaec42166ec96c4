from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.operators import features, validation
from meterwise.schemas import CLUSTER_UTILIZATION, JOB_COST_TREND, JOB_HEALTH, conform

RUNS = (
    "workspace_id string, job_id string, run_id long, period_start_time timestamp, period_end_time timestamp, "
    "result_state string"
)
JOBS = "workspace_id string, job_id string, name string, change_time timestamp"
NODES = (
    "cluster_id string, workspace_id string, instance_id string, node_type string, start_time timestamp, "
    "cpu_user_percent double, mem_used_percent double"
)


@pytest.fixture
def jobs(frame):
    return frame([("w", "1", "one", "2024-01-01 00:00:00"), ("w", "1", "uno", "2023-01-01 00:00:00")], JOBS)


def cost_inputs(frame, days):
    usage = frame(
        [("w", "1", d, f"{d} 00:00:00", "s", "c", q) for d, q in days],
        "workspace_id string, job_id string, usage_date date, usage_start_time timestamp, sku_name string, "
        "cloud string, usage_quantity double",
    )
    prices = frame(
        [("c", "s", "2020-01-01 00:00:00", None, 1.0)],
        "cloud string, sku_name string, price_start_time timestamp, price_end_time timestamp, unit_price double",
    )
    return usage, prices


def test_first_row_has_no_growth_and_gaps_count_as_rows(frame, jobs, clock, cfg):
    usage, prices = cost_inputs(frame, [("2024-01-01", 10.0), ("2024-01-20", 20.0), ("2024-01-21", 15.0)])
    trend = features.job_cost_trend(usage, prices, jobs, clock, cfg).orderBy("usage_date").collect()
    assert [r["cost_growth_pct"] for r in trend] == [None, 1.0, 0.0]
    assert [r["rolling_14d_avg"] for r in trend] == [10.0, 15.0, 15.0]
    assert {r["job_name"] for r in trend} == {"one"}


def test_calendar_frames_do_not_reach_over_a_gap(frame, jobs, clock, cfg):
    usage, prices = cost_inputs(frame, [("2024-01-01", 10.0), ("2024-01-20", 20.0), ("2024-01-21", 15.0)])
    trend = features.job_cost_trend_calendar(usage, prices, jobs, clock, cfg).orderBy("usage_date").collect()
    assert [r["cost_growth_pct"] for r in trend] == [None, None, -0.25]
    assert [r["rolling_14d_avg"] for r in trend] == [10.0, 20.0, 17.5]


def test_zero_baseline_gives_no_growth(frame, jobs, clock, cfg):
    usage, prices = cost_inputs(frame, [("2024-01-01", 0.0), ("2024-01-02", 5.0)])
    trend = features.job_cost_trend(usage, prices, jobs, clock, cfg).orderBy("usage_date").collect()
    assert trend[1]["cost_growth_pct"] is None


def test_cost_window_is_sixty_days_and_ends_at_as_of(frame, jobs, clock, cfg):
    usage, prices = cost_inputs(
        frame, [("2023-12-01", 1.0), ("2023-12-02", 1.0), ("2024-01-31", 1.0), ("2024-02-01", 1.0)]
    )
    daily = features.job_daily_cost(usage, prices, jobs, clock, cfg)
    assert rows_of(daily, F.col("usage_date").cast("string")) == [("2023-12-02",), ("2024-01-31",)]


def runs(frame):
    return frame(
        [
            # three periods of one run: counted once, 30 minutes in all
            ("w", "1", 1, "2024-01-20 00:00:00", "2024-01-20 00:10:00", None),
            ("w", "1", 1, "2024-01-20 00:10:00", "2024-01-20 00:20:00", None),
            ("w", "1", 1, "2024-01-20 00:20:00", "2024-01-20 00:30:00", "SUCCEEDED"),
            # still running
            ("w", "1", 2, "2024-01-21 00:00:00", None, None),
            # has a state and no end
            ("w", "1", 3, "2024-01-21 00:00:00", None, "SUCCEEDED"),
            # ends before it starts
            ("w", "1", 4, "2024-01-21 01:00:00", "2024-01-21 00:00:00", "FAILED"),
            # other failure states are not FAILED
            ("w", "2", 5, "2024-01-21 00:00:00", "2024-01-21 00:00:10", "TIMED_OUT"),
            # failed, then repaired: the greatest state wins
            ("w", "2", 6, "2024-01-21 00:00:00", "2024-01-21 00:00:05", "SUCCEEDED"),
            ("w", "2", 6, "2024-01-21 00:00:05", "2024-01-21 00:00:20", "FAILED"),
            # canceled sorts before failed
            ("w", "2", 7, "2024-01-21 00:00:00", "2024-01-21 00:00:20", "CANCELED"),
            ("w", "2", 7, "2024-01-21 00:00:05", "2024-01-21 00:00:30", "FAILED"),
            # before the window
            ("w", "1", 8, "2023-12-31 23:00:00", "2023-12-31 23:30:00", "FAILED"),
        ],
        RUNS,
    )


def test_health_counts_completed_runs_once(frame, jobs, clock, cfg):
    health = features.job_health(runs(frame), jobs, clock, cfg)
    by_job = {r["job_id"]: r for r in health.collect()}
    one, two = by_job["1"], by_job["2"]
    assert (one["total_runs"], one["failed_runs"], one["avg_duration_secs"]) == (1, 0, 1800.0)
    assert one["stddev_duration"] is None
    assert (two["total_runs"], two["failed_runs"], two["failure_rate"]) == (3, 1, 0.3333)
    assert (two["job_name"], one["job_name"]) == (None, "one")


def test_outcome_flags_agree_with_states(frame, clock):
    states = features.completed_runs(runs(frame), clock, 30)
    flags = features.timed_runs(runs(frame), clock, 30)
    expected = states.select("run_id", "duration_secs", (F.col("result_state") == "FAILED").alias("failed"))
    assert rows_of(expected) == rows_of(flags, "run_id", "duration_secs", "failed")


def test_last_state_differs_from_greatest_state(frame, clock):
    greatest = dict(rows_of(features.job_runs_collapsed(runs(frame), clock, 30), "run_id", "result_state"))
    last = dict(rows_of(features.job_runs_last_state(runs(frame), clock, 30), "run_id", "result_state"))
    assert greatest[6] == "SUCCEEDED" and last[6] == "FAILED"
    assert greatest[2] is None and last[2] is None


def test_hourly_counts_nodes_not_samples(frame, clock, cfg):
    nodes = frame(
        [
            ("1", "w", "i1", "a", "2024-01-20 10:00:00", 10.0, 50.0),
            ("1", "w", "i1", "a", "2024-01-20 10:01:00", 20.0, None),
            ("1", "w", "i1", "b", "2024-01-20 10:02:00", 30.0, 10.0),
            ("1", "w", "i2", "a", "2024-01-20 10:59:59", 60.0, 30.0),
            ("1", "w", "i2", "a", "2024-01-20 11:00:00", None, None),
        ],
        NODES,
    )
    ten, eleven = features.cluster_hourly_utilization(nodes, clock, cfg).orderBy("hour_window").collect()
    assert (ten["avg_cpu_pct"], ten["peak_cpu_pct"], ten["avg_mem_pct"], ten["peak_mem_pct"]) == (30.0, 60.0, 30.0, 50.0)
    assert (ten["node_count"], ten["node_type_count"]) == (2, 2)
    assert (eleven["avg_cpu_pct"], eleven["node_count"]) == (None, 1)


def test_features_have_the_declared_schemas(frame, jobs, clock, cfg):
    usage, prices = cost_inputs(frame, [("2024-01-01", 10.0)])
    nodes = frame([("1", "w", "i1", "a", "2024-01-20 10:00:00", 10.0, 50.0)], NODES)
    for feature, schema in [
        (features.cluster_hourly_utilization(nodes, clock, cfg), CLUSTER_UTILIZATION),
        (features.job_cost_trend(usage, prices, jobs, clock, cfg), JOB_COST_TREND),
        (features.job_health(runs(frame), jobs, clock, cfg), JOB_HEALTH),
    ]:
        stamped = features.stamped(feature, clock)
        assert [(f.name, f.dataType) for f in stamped.schema] == [(f.name, f.dataType) for f in schema]
        assert conform(stamped, schema).count() == stamped.count()


def test_conform_refuses_other_columns(frame):
    with pytest.raises(ValueError, match="unknown"):
        conform(frame([("x",)], "surprise string"), JOB_HEALTH)


def test_anomaly_needs_a_spread_and_the_latest_run(frame, jobs, clock, cfg):
    steady = [("w", "1", i, f"2024-01-{10 + i} 00:00:00", f"2024-01-{10 + i} 00:01:{i:02d}", "SUCCEEDED") for i in range(15)]
    slow = [("w", "1", 99, "2024-01-30 00:00:00", "2024-01-30 01:00:00", "SUCCEEDED")]
    flat = [("w", "2", i, f"2024-01-2{i} 00:00:00", f"2024-01-2{i} 00:01:00", "SUCCEEDED") for i in range(5)]
    table = frame(steady + slow + flat, RUNS)
    health = features.job_health(table, jobs, clock, cfg)
    assert rows_of(validation.latest_run_anomalies(health, table, clock, cfg), "job_id", "latest_duration_s") == [
        ("1", 3600)
    ]


def test_rounding_is_symmetric_and_relative(spark):
    from meterwise.functions.numeric import steady_round

    values = spark.createDataFrame([(-2.5,), (2.5,), (0.0,), (1e9 + 0.005 - 1e-7,)], "x double")
    assert [r[0] for r in values.select(steady_round(F.col("x"), 0)).collect()] == [-3.0, 3.0, 0.0, 1e9]
    assert values.select(steady_round(F.col("x"), 2)).collect()[3][0] == 1e9 + 0.01


def test_a_growth_just_over_the_threshold_is_a_spike(frame, clock, cfg):
    from meterwise.operators.validation import top_cost_spikes

    schema = "workspace_id string, job_id string, job_name string, usage_date date, daily_cost_usd double, rolling_14d_avg double, cost_growth_pct double"
    trend = frame([("w", "j", "n", "2024-01-30", 1.0, 1.0, 0.25003), ("w", "k", "n", "2024-01-30", 1.0, 1.0, 0.25)], schema)
    assert top_cost_spikes(trend, clock, cfg).count() == 1
