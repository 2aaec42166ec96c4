"""Refresh by days against a full rebuild."""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.plans import incremental
from meterwise.plans.features import Features
from meterwise.sources.driver_tables import CLOCK, CONFIG, load
from meterwise.sources.platform import PlatformTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def database(spark):
    name = f"days_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


@pytest.fixture(scope="module")
def whole(spark):
    return load(spark, FOLDER)


def given(whole, **other):
    """The tables with some of them replaced."""
    names = ("usage", "list_prices", "jobs", "node_timeline")
    return PlatformTables(whole.spark, {n: (lambda n=n: other.get(n, getattr(whole, n))) for n in names})


def trend_of(features):
    places = [F.round(c, 6).alias(c) for c in ("daily_cost_usd", "rolling_14d_avg", "cost_growth_pct")]
    return rows_of(features.trend, "workspace_id", "job_id", "job_name", "usage_date", *places)


def hours_of(features):
    places = [F.round(c, 6).alias(c) for c in ("avg_cpu_pct", "peak_cpu_pct", "avg_mem_pct", "peak_mem_pct")]
    return rows_of(features.hourly, "cluster_id", "workspace_id", "hour_window", *places, "node_count", "node_type_count")


def files_of(spark, table, column):
    read = spark.table(table).select(column, F.input_file_name().alias("file")).distinct()
    found = {}
    for r in read.collect():
        found.setdefault(r[column], set()).add(r["file"])
    return found


def test_hours_equal_a_rebuild_and_other_days_keep_their_files(spark, whole, database):
    table = f"{database}.{incremental.HOURS}"
    nodes = whole.node_timeline
    late = nodes.where("start_time >= '2024-01-12 05:00:00' AND start_time < '2024-01-12 06:00:00'")
    first = given(whole, node_timeline=nodes.exceptAll(late))
    all_days = incremental.refresh_hours(first, database, CLOCK, CONFIG)
    assert len(all_days) > 20
    assert hours_of(incremental.DayFeatures(first, database)) == hours_of(Features(first, CLOCK, CONFIG))
    before = files_of(spark, table, "day")
    assert incremental.refresh_hours(whole, database, CLOCK, CONFIG) == [date(2024, 1, 12)]
    after = files_of(spark, table, "day")
    assert {d for d in before if before[d] != after[d]} == {date(2024, 1, 12)}
    assert hours_of(incremental.DayFeatures(whole, database)) == hours_of(Features(whole, CLOCK, CONFIG))
    assert incremental.refresh_hours(whole, database, CLOCK, CONFIG) == []


def test_days_without_rows_any_more_are_dropped(spark, whole, database):
    incremental.refresh_hours(whole, database, CLOCK, CONFIG)
    fewer = given(whole, node_timeline=whole.node_timeline.where("to_date(start_time) <> '2024-01-09'"))
    assert incremental.refresh_hours(fewer, database, CLOCK, CONFIG) == [date(2024, 1, 9)]
    assert hours_of(incremental.DayFeatures(fewer, database)) == hours_of(Features(fewer, CLOCK, CONFIG))
    none = given(whole, node_timeline=whole.node_timeline.where("false"))
    incremental.refresh_hours(none, database, CLOCK, CONFIG)
    assert hours_of(incremental.DayFeatures(none, database)) == []


def test_changed_days_reach_the_scan(spark, whole):
    days = [date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 9)]
    length = "spark.sql.maxMetadataStringLength"
    spark.conf.set(length, "1000")
    try:
        plan = whole.node_timeline.where(incremental.within(days, "start_time"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(length)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    for bound in ("2024-01-03", "2024-01-05", "2024-01-09", "2024-01-10"):
        assert bound in pushed
    assert "2024-01-04" not in pushed  # consecutive days are one range


def test_trend_equals_a_rebuild_as_days_go_by(spark, whole, database):
    for back in (9, 3, 0):
        clock = Clock(CLOCK.as_of - timedelta(days=back))
        incremental.refresh_costs(whole, database, clock, CONFIG)
        assert trend_of(incremental.DayFeatures(whole, database)) == trend_of(Features(whole, clock, CONFIG))


def test_late_usage_lost_usage_and_new_prices(spark, whole, database):
    """Each is found by the marks, and the trend of jobs that seldom run is replaced however far away."""
    incremental.refresh_costs(whole, database, CLOCK, CONFIG)
    usage, prices = whole.usage, whole.list_prices
    seldom = usage.where("job_id <> '7' OR day(usage_date) % 5 = 0")
    cases = [
        (given(whole, usage=seldom), None),
        (given(whole, usage=seldom.where("usage_date <> '2024-01-05'")), [date(2024, 1, 5)]),
        (given(whole, usage=seldom), [date(2024, 1, 5)]),
        (given(whole, usage=seldom, list_prices=prices.withColumn("unit_price", F.when(F.col("price_end_time").isNull(), 0.5).otherwise(F.col("unit_price")))), None),
    ]
    for tables, days in cases:
        found, touched = incremental.refresh_costs(tables, database, CLOCK, CONFIG)
        assert found and (days is None or found == days) and set(found) <= set(touched)
        assert min(touched) >= min(found)
        assert trend_of(incremental.DayFeatures(tables, database)) == trend_of(Features(tables, CLOCK, CONFIG))
    assert min(found) == date(2024, 1, 14)  # the price holds from the 15th; the day before may start late
    assert incremental.refresh_costs(tables, database, CLOCK, CONFIG) == ([], [])


@pytest.mark.parametrize("step", ["trend", "costs"])
def test_a_refresh_that_ended_midway_is_done_over(spark, whole, database, monkeypatch, step):
    incremental.refresh_costs(whole, database, CLOCK, CONFIG)
    fewer = given(whole, usage=whole.usage.where("NOT (usage_date = '2024-01-05' AND job_id IN ('1', '2'))"))
    ends = {"trend": incremental.COSTS, "costs": incremental.MARKS}[step]
    replace, publish = incremental.replace_days, incremental.publish_version

    def replace_or_end(df, table, *rest):
        if table.endswith(ends):
            raise RuntimeError("lost")
        replace(df, table, *rest)

    def publish_or_end(df, name):
        if name.endswith(ends):
            raise RuntimeError("lost")
        return publish(df, name)

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "replace_days", replace_or_end)
        patched.setattr(incremental, "publish_version", publish_or_end)
        with pytest.raises(RuntimeError, match="lost"):
            incremental.refresh_costs(fewer, database, CLOCK, CONFIG)
    incremental.refresh_costs(fewer, database, CLOCK, CONFIG)
    assert trend_of(incremental.DayFeatures(fewer, database)) == trend_of(Features(fewer, CLOCK, CONFIG))


def test_only_touched_partitions_are_replaced(spark, frame, database):
    """A job with spend on every day: 13 days follow a change."""
    days = [date(2024, 1, 1) + timedelta(days=n) for n in range(30)]
    schema = "workspace_id string, job_id string, usage_date date, usage_start_time timestamp, cloud string, sku_name string, usage_quantity double"

    def usage(more):
        rows = [("w", "j", str(d), f"{d} 03:00:00", "c", "s", 1.0 + (more if d.day == 5 else 0)) for d in days]
        return frame(rows, schema)

    prices = frame([("c", "s", "2023-01-01 00:00:00", None, 2.0)], "cloud string, sku_name string, price_start_time timestamp, price_end_time timestamp, unit_price double")
    jobs = frame([("w", "j", "name", "2023-01-01 00:00:00")], "workspace_id string, job_id string, name string, change_time timestamp")
    clock = Clock(datetime(2024, 1, 31))
    tables = lambda more: PlatformTables(spark, {"usage": lambda: usage(more), "list_prices": lambda: prices, "jobs": lambda: jobs})
    incremental.refresh_costs(tables(0.0), database, clock, CONFIG)
    before = files_of(spark, f"{database}.{incremental.TRENDS}", "usage_date")
    assert incremental.refresh_costs(tables(5.0), database, clock, CONFIG) == (days[4:5], days[4:18])
    after = files_of(spark, f"{database}.{incremental.TRENDS}", "usage_date")
    assert sorted(d for d in before if before[d] != after[d]) == days[4:18]
    assert trend_of(incremental.DayFeatures(tables(5.0), database)) == trend_of(Features(tables(5.0), clock, CONFIG))


def test_marks_tell_rows_apart(spark):
    """Order does not count; repeats and the place of a null do."""
    def of(*rows):
        df = spark.createDataFrame(rows, "d int, a string, b string")
        return rows_of(incremental.marks(df, F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")), ["a", "b"]))

    one, two = (0, "x", "y"), (0, "y", "x")
    assert of(one, two) == of(two, one)
    assert len({repr(of(*r)) for r in ([one], [two], [one, one], [(0, "x", None)], [(0, None, "x")])}) == 5
