"""Refresh of the hourly utilisation and the daily cost by the days that changed.

The tables are partitioned by day. A day has changed if its mark, a count and a sum of row
hashes of its source rows, differs from the one stored at the last refresh; marks need one
scan of the source and no shuffle beyond a row per day and task. Only changed days are computed from the
source, and only the partitions that hold another result are replaced.

Marks are stored last, and nothing that decides what is replaced is overwritten before: a refresh that
ends midway is done over by the next one, with the same result. One writer at a time. Days are
bounded by the windows of the configuration (at most 61), so lists of days may pass the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import schemas
from meterwise.clock import Clock, date_literal, timestamp_literal
from meterwise.config import Config
from meterwise.operators.features import cluster_hourly_utilization, stamped, with_trend
from meterwise.operators.versions import JOB_KEY, priced_usage, with_job_name
from meterwise.schemas import conform
from meterwise.session import settle
from meterwise.sinks.tables import create_day_table_if_missing, publish_version, replace_days
from meterwise.sources.platform import PlatformTables

HOURS, COSTS, TRENDS, MARKS = "days_of_utilization", "days_of_cost", "days_of_trend", "days_marked"
# Rows of a job, besides its own, that the greatest frame of the trend reads.
FRAME_ROWS = 13

_MARK = T.StructType().add("day", "date").add("mark", "decimal(38,0)")


def _schema(feature: T.StructType, without: Sequence[str], day: str) -> T.StructType:
    kept = [f for f in feature.fields if f.name not in without and f.name != day]
    return T.StructType([*kept, T.StructField(day, T.DateType())])


HOURS_SCHEMA = _schema(schemas.CLUSTER_UTILIZATION, (), "day")
TRENDS_SCHEMA = _schema(schemas.JOB_COST_TREND, ("job_name",), "usage_date")
COSTS_SCHEMA = _schema(schemas.JOB_COST_TREND, ("job_name", "rolling_14d_avg", "cost_growth_pct", "updated_at"), "usage_date")


def marks(rows: DataFrame, day: Column, columns: Sequence[str]) -> DataFrame:
    """``day`` and ``mark`` of the rows' days. The order of rows does not matter, repeated rows do."""
    # Each row adds its hash and, beyond all hashes, one: the count. Hashes pass over nulls, so their places go in too.
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)") + F.lit(str(1 << 64)).cast("decimal(38,0)")
    return rows.groupBy(day.alias("day")).agg(F.sum(row).cast("decimal(38,0)").alias("mark"))


def _merged(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("day").agg(F.sum("mark").cast("decimal(38,0)").alias("mark"))


def node_marks(nodes: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    recent = nodes.where(clock.times_since("start_time", clock.midnight_ago(cfg.utilization_days)))
    used = ["cluster_id", "workspace_id", "instance_id", "node_type", "start_time", "cpu_user_percent", "mem_used_percent"]
    return marks(recent, F.to_date("start_time"), used)


def _billed(usage: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    return usage.where(F.col("job_id").isNotNull() & clock.dates_since("usage_date", clock.date_ago(cfg.cost_days)))


def usage_marks(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Marks of billed usage. Prices in force on a day, or the day before or after it, are part of its mark, as
    usage may start on another day than it is booked on; days without usage have none."""
    used = [*JOB_KEY, "usage_date", "usage_start_time", "cloud", "sku_name", "usage_quantity"]
    spent = settle(marks(_billed(usage, clock, cfg), F.col("usage_date"), used), "usage-marks")
    first = F.greatest(F.date_sub(F.to_date("price_start_time"), 1), clock.date_ago(cfg.cost_days))
    last = F.least(F.coalesce(F.date_add(F.to_date("price_end_time"), 1), clock.today), clock.today)
    days = F.when(first <= last, F.sequence(first, last))
    dated = prices.withColumn("day", F.explode(days))
    priced = marks(dated, F.col("day"), ["cloud", "sku_name", "price_start_time", "price_end_time", "unit_price"])
    return _merged(spent, priced.join(spent, "day", "left_semi"))


def changed_days(spark: SparkSession, database: str, feature: str, now: DataFrame) -> list[date]:
    """Days whose mark is new, another one, or gone."""
    before = spark.table(f"{database}.{MARKS}").where(F.col("feature") == feature).select("day", F.col("mark").alias("old"))
    met = before.join(now, "day", "full_outer").where(~F.col("mark").eqNullSafe(F.col("old")))
    return sorted(r["day"] for r in met.select("day").collect())


def _spans(days: Sequence[date]) -> list[tuple[date, date]]:
    """Runs of consecutive days, the end exclusive."""
    spans: list[tuple[date, date]] = []
    for day in sorted(days):
        if spans and spans[-1][1] == day:
            spans[-1] = spans[-1][0], day + timedelta(days=1)
        else:
            spans.append((day, day + timedelta(days=1)))
    return spans


def within(days: Sequence[date], column: str) -> Column:
    """Whether a timestamp lies on one of the days: ranges of the raw column, which reach the scan."""
    at = lambda day: timestamp_literal(datetime.combine(day, datetime.min.time()))
    ranges = [(F.col(column) >= at(a)) & (F.col(column) < at(b)) for a, b in _spans(days)]
    return reduce(Column.__or__, ranges, F.lit(False))


def on_days(days: Sequence[date], column: str) -> Column:
    return F.col(column).isin([date_literal(d) for d in days]) if days else F.lit(False)


def create_day_tables(spark: SparkSession, database: str) -> None:
    for name, schema in ((HOURS, HOURS_SCHEMA), (COSTS, COSTS_SCHEMA), (TRENDS, TRENDS_SCHEMA)):
        create_day_table_if_missing(spark, f"{database}.{name}", schema)
    if not spark.catalog.tableExists(f"{database}.{MARKS}"):
        publish_version(spark.createDataFrame([], T.StructType([T.StructField("feature", T.StringType()), *_MARK.fields])), f"{database}.{MARKS}")


def _remember(spark: SparkSession, database: str, feature: str, now: DataFrame) -> None:
    others = spark.table(f"{database}.{MARKS}").where(F.col("feature") != feature)
    publish_version(others.unionByName(now.select(F.lit(feature).alias("feature"), "day", "mark")).coalesce(1), f"{database}.{MARKS}")


def refresh_hours(tables: PlatformTables, database: str, clock: Clock, cfg: Config) -> list[date]:
    """Bring the hourly utilisation up to date; gives back the days that were replaced."""
    spark, table = tables.spark, f"{database}.{HOURS}"
    create_day_tables(spark, database)
    now = settle(node_marks(tables.node_timeline, clock, cfg), "marks")
    days = changed_days(spark, database, HOURS, now)
    if days:
        changed = tables.node_timeline.where(within(days, "start_time"))
        hours = stamped(cluster_hourly_utilization(changed, clock, cfg), clock).withColumn("day", F.to_date("hour_window"))
        replace_days(conform(hours, HOURS_SCHEMA), table, "day", days)
        _remember(spark, database, HOURS, now)
    return days


def _daily(usage: DataFrame, prices: DataFrame, cfg: Config) -> DataFrame:
    return priced_usage(usage, prices, cfg).groupBy(*JOB_KEY, "usage_date").agg(F.sum("cost_usd").alias("daily_cost_usd"))


def touched_days(before: DataFrame, after: DataFrame, days: Sequence[date]) -> list[date]:
    """Days on which the trend of some job may have changed: the changed ``days``, and those of a job's next rows
    whose frames reach back to a row that it has, or had, on a changed day.

    Frames count rows, so a day may lie far behind the change for a job that seldom runs. Rows that are gone
    keep their place here: between a row and the last change before it none is gone, so
    the distance is the one in the table.
    """
    gone = before.where(on_days(days, "usage_date")).select(*JOB_KEY, "usage_date")
    rows = after.select(*JOB_KEY, "usage_date").union(gone).distinct()
    frame = Window.partitionBy(*JOB_KEY).orderBy("usage_date").rowsBetween(-FRAME_ROWS, 0)
    touched = rows.withColumn("touched", F.max(on_days(days, "usage_date")).over(frame)).where("touched")
    return sorted({*days, *(r["usage_date"] for r in touched.select("usage_date").distinct().collect())})


def refresh_costs(tables: PlatformTables, database: str, clock: Clock, cfg: Config) -> tuple[list[date], list[date]]:
    """Bring daily costs and their trend up to date. Gives back the days computed from usage anew, and those whose
    trend was replaced. Days that leave the window count as changed: frames that held them are shorter now."""
    spark = tables.spark
    create_day_tables(spark, database)
    now = settle(usage_marks(tables.usage, tables.list_prices, clock, cfg), "marks")
    days = changed_days(spark, database, TRENDS, now)
    if not days:
        return [], []
    before = spark.table(f"{database}.{COSTS}")
    recent = _billed(tables.usage, clock, cfg).where(on_days(days, "usage_date"))
    fresh = settle(conform(_daily(recent, tables.list_prices, cfg), COSTS_SCHEMA), "daily-cost")
    after = before.where(~on_days(days, "usage_date")).unionByName(fresh)
    touched = touched_days(before, after, days)
    by_day = Window.partitionBy(*JOB_KEY).orderBy("usage_date")
    trend = with_trend(after.withColumn("job_name", F.lit(None).cast("string")), by_day.rowsBetween(-13, 0), by_day.rowsBetween(-7, -1))
    trend = stamped(trend.where(on_days(touched, "usage_date")), clock)
    # The costs as they were decide what is touched, so they are replaced after the trend.
    replace_days(conform(trend.drop("job_name"), TRENDS_SCHEMA), f"{database}.{TRENDS}", "usage_date", touched)
    replace_days(fresh, f"{database}.{COSTS}", "usage_date", days)
    _remember(spark, database, TRENDS, now)
    return days, touched


class DayFeatures:
    """The hourly utilisation and the cost trend, read from the tables of days. Names of jobs are joined on reading, as a
    new name concerns all days of a job; ``updated_at`` is the refresh that computed the row."""

    def __init__(self, tables: PlatformTables, database: str):
        self._tables, self._database = tables, database

    @property
    def hourly(self) -> DataFrame:
        rows = self._tables.spark.table(f"{self._database}.{HOURS}").drop("day")
        return conform(rows, schemas.CLUSTER_UTILIZATION)

    @property
    def trend(self) -> DataFrame:
        rows = self._tables.spark.table(f"{self._database}.{TRENDS}")
        return conform(with_job_name(rows, self._tables.jobs), schemas.JOB_COST_TREND)


def refresh_days(tables: PlatformTables, database: str, clock: Clock, cfg: Config) -> DayFeatures:
    """Bring both features up to date. Equal to a full rebuild but for ``updated_at``."""
    refresh_hours(tables, database, clock, cfg)
    refresh_costs(tables, database, clock, cfg)
    return DayFeatures(tables, database)
