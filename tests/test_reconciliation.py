"""Each check passes on sound features and fails when its own invariant is broken."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.operators import reconciliation as recon
from meterwise.plans.features import SettledFeatures
from meterwise.sources.driver_tables import CLOCK, CONFIG, load


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sound(tables):
    return SettledFeatures(tables, CLOCK, CONFIG)


def status(rows, check_id):
    found = [r["status"] for r in rows.where(F.col("check_id") == check_id).collect()]
    assert len(found) == 1
    return found[0]


def doubled(df):
    return df.unionByName(df)


def shifted(df, column, by):
    return df.withColumn(column, F.col(column) + by)


WEEK_OLD = Clock(CLOCK.as_of + timedelta(days=7))

UTILIZATION = {
    "C2": lambda h: shifted(h, "peak_mem_pct", 100),
    "C4": lambda h: h.withColumn("cluster_id", F.lit(None).cast("string")),
}
COST = {
    "J2": doubled,
    "J3": lambda t: shifted(t, "daily_cost_usd", -1e9),
    "J5": lambda t: shifted(t, "cost_growth_pct", 11),
}
HEALTH = {
    "H1": doubled,
    "H4": lambda h: shifted(h, "failed_runs", 10**9),
    "H5": lambda h: shifted(h, "avg_duration_secs", 10**6),
}


@pytest.mark.parametrize("check_id", UTILIZATION)
def test_utilization(sound, check_id):
    assert status(recon.utilization_checks(sound.hourly, CLOCK), check_id) == "PASS"
    assert status(recon.utilization_checks(UTILIZATION[check_id](sound.hourly), CLOCK), check_id) == "FAIL"


@pytest.mark.parametrize("check_id", COST)
def test_cost(sound, check_id):
    assert status(recon.cost_checks(sound.trend, CLOCK), check_id) == "PASS"
    assert status(recon.cost_checks(COST[check_id](sound.trend), CLOCK), check_id) == "FAIL"


@pytest.mark.parametrize("check_id", HEALTH)
def test_health(sound, check_id):
    assert status(recon.health_checks(sound.health, CLOCK), check_id) == "PASS"
    assert status(recon.health_checks(HEALTH[check_id](sound.health), CLOCK), check_id) == "FAIL"


@pytest.mark.parametrize(
    ("check_id", "checks", "feature"),
    [
        ("C3", recon.utilization_checks, "hourly"),
        ("J4", recon.cost_checks, "trend"),
        ("H6", recon.health_checks, "health"),
    ],
)
def test_freshness(sound, check_id, checks, feature):
    table = getattr(sound, feature)
    assert status(checks(table, CLOCK), check_id) == "PASS"
    assert status(checks(table, WEEK_OLD), check_id) == "FAIL"
    assert status(checks(table.where("false"), CLOCK), check_id) == "FAIL"


def test_row_count(sound, tables):
    assert status(recon.hourly_row_count(sound.hourly, tables.node_timeline, CLOCK), "C1") == "PASS"
    fanned = doubled(sound.hourly)
    assert status(recon.hourly_row_count(fanned, tables.node_timeline, CLOCK), "C1") == "FAIL"


def test_busiest_means(sound, tables):
    # Every hour of the busiest cluster gives one mean; shifting all of them must fail.
    off = shifted(sound.hourly, "avg_cpu_pct", 50)
    assert status(recon.busiest_cluster_means(off, tables.node_timeline, CLOCK), "C5") == "FAIL"
    one_sample = tables.node_timeline.groupBy("cluster_id", "workspace_id", F.date_trunc("hour", "start_time").alias("start_time")).agg(
        F.avg("cpu_user_percent").alias("cpu_user_percent"), F.avg("mem_used_percent").alias("mem_used_percent"))
    assert status(recon.busiest_cluster_means(sound.hourly, one_sample, CLOCK), "C5") == "PASS"


def test_price_fan_out_is_seen(sound, tables):
    good = recon.yesterdays_cost(sound.trend, tables.usage, tables.list_prices, CLOCK, CONFIG)
    assert status(good, "J1") == "PASS"
    fanned = shifted(sound.trend, "daily_cost_usd", F.col("daily_cost_usd") * 2)
    assert status(recon.yesterdays_cost(fanned, tables.usage, tables.list_prices, CLOCK, CONFIG), "J1") == "FAIL"
    gone = sound.trend.where("false")
    assert status(recon.yesterdays_cost(gone, tables.usage, tables.list_prices, CLOCK, CONFIG), "J1") == "FAIL"


@pytest.mark.parametrize(("check_id", "column"), [("H2", "total_runs"), ("H3", "failed_runs")])
def test_run_totals(sound, tables, check_id, column):
    assert status(recon.run_total_checks(sound.health, tables.job_run_timeline, CLOCK, CONFIG), check_id) == "PASS"
    inflated = shifted(sound.health, column, 100)
    assert status(recon.run_total_checks(inflated, tables.job_run_timeline, CLOCK, CONFIG), check_id) == "FAIL"


@pytest.mark.parametrize(
    ("check_id", "column", "value"),
    [("A1", "status", "unheard"), ("A1", "status", None), ("A2", "projected_savings", -1.0), ("A2", "target_id", None),
     ("A2", "action_timestamp", "2024-02-01 00:00:00"), ("A3", "details", "{bad")],
)
def test_actions(tables, check_id, column, value):
    log = tables.agent_action_log.withColumns({"projected_savings": F.lit(1.0), "details": F.lit('{"k": 1}')})
    assert status(recon.action_checks(log, CLOCK), check_id) == "PASS"
    kind = dict(log.dtypes)[column]
    broken = log.withColumn(column, F.lit(value).cast(kind))
    assert status(recon.action_checks(broken, CLOCK), check_id) == "FAIL"


def test_null_details_are_allowed(tables):
    log = tables.agent_action_log.withColumn("details", F.lit(None).cast("string"))
    assert status(recon.action_checks(log, CLOCK), "A3") == "PASS"


def failing(compared):
    return compared.where(~F.col("agrees")).count()


@pytest.mark.parametrize(("column", "by"), [("total_runs", 50), ("failed_runs", 50), ("avg_duration_secs", 31)])
def test_job_spots(sound, tables, column, by):
    runs = tables.job_run_timeline
    assert failing(recon.job_spot_check(sound.trend, sound.health, runs, CLOCK, CONFIG)) == 0
    off = shifted(sound.health, column, by)
    assert failing(recon.job_spot_check(sound.trend, off, runs, CLOCK, CONFIG)) == 5


@pytest.mark.parametrize(("column", "by"), [("node_count", 2), ("avg_cpu_pct", 4)])
def test_cluster_spots(sound, tables, column, by):
    assert failing(recon.cluster_spot_check(sound.hourly, tables.node_timeline, CLOCK)) == 0
    off = shifted(sound.hourly, column, by)
    assert failing(recon.cluster_spot_check(off, tables.node_timeline, CLOCK)) == 5


def test_cost_spots(sound, tables):
    args = (tables.usage, tables.list_prices, CLOCK, CONFIG)
    compared = recon.job_cost_spot_check(sound.trend, *args)
    with_cost = compared.where("src_usd > 0").count()
    assert with_cost > 0 and failing(compared) == 0
    twice = shifted(sound.trend, "daily_cost_usd", F.col("daily_cost_usd"))
    assert failing(recon.job_cost_spot_check(twice, *args)) == with_cost


def test_spot_check_of_one_job(sound, tables):
    compared = recon.job_spot_check(sound.trend, sound.health, tables.job_run_timeline, CLOCK, CONFIG, job_id="3")
    assert [r["job_id"] for r in compared.collect()] == ["3"]


def test_top_driver(sound):
    assert status(recon.top_driver_runs(sound.trend, sound.health, CLOCK), "X1") == "PASS"
    assert status(recon.top_driver_runs(sound.trend, sound.health.where("false"), CLOCK), "X1") == "FAIL"


def test_over_provisioned(monkeypatch, sound, tables):
    assert status(recon.over_provisioned_bounds(sound.hourly, tables.clusters, CLOCK, CONFIG), "X2") == "PASS"
    listed = recon.cluster_over_provisioned
    monkeypatch.setattr(
        recon, "cluster_over_provisioned", lambda *args: shifted(listed(*args), "avg_cpu_7d", 100)
    )
    assert status(recon.over_provisioned_bounds(sound.hourly, tables.clusters, CLOCK, CONFIG), "X2") == "FAIL"


def test_modes(sound, tables):
    fast = {r["check_id"] for r in recon.reconcile(sound, tables, CLOCK, CONFIG, "fast").collect()}
    full = {r["check_id"] for r in recon.reconcile(sound, tables, CLOCK, CONFIG, "full").collect()}
    assert fast == {"C2", "C3", "C4", "J2", "J3", "J4", "H1", "H4", "H6", "A1", "A2", "A3"}
    assert full - fast == {"C1", "C5", "J1", "J5", "H2", "H3", "H5", "S1", "S2", "S3", "X1", "X2"}
    drilled = recon.reconcile(sound, tables, CLOCK, CONFIG, "fast", job_id="3").collect()
    assert {r["check_id"] for r in drilled} - fast == {"S1", "S2", "S3"}
    with pytest.raises(ValueError):
        recon.reconcile(sound, tables, CLOCK, CONFIG, "slow")


def test_summary_raises_only_for_critical(sound, tables):
    fine = recon.recon_summary(recon.cost_checks(sound.trend, CLOCK))
    recon.raise_on_critical(fine)
    broken = SimpleNamespace(hourly=sound.hourly, trend=doubled(sound.trend), health=sound.health)
    summary = recon.recon_summary(recon.reconcile(broken, tables, CLOCK, CONFIG, "fast"))
    assert summary.first()["critical_failed"] == 1
    with pytest.raises(RuntimeError, match="1 critical"):
        recon.raise_on_critical(summary)
