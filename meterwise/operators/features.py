"""The three feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import count_where, ratio, steady_round
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY, priced_usage, with_job_name

HOUR_KEY = [*CLUSTER_KEY, "hour_window"]
RUN_KEY = [*JOB_KEY, "run_id"]


# --- hourly cluster utilisation ------------------------------------------------


def _sums() -> list[Column]:
    """Mergeable sums of samples."""
    return [
        F.sum("cpu_user_percent").alias("cpu_sum"),
        F.count("cpu_user_percent").alias("cpu_n"),
        F.max("cpu_user_percent").alias("cpu_max"),
        F.sum("mem_used_percent").alias("mem_sum"),
        F.count("mem_used_percent").alias("mem_n"),
        F.max("mem_used_percent").alias("mem_max"),
    ]


def _cluster_hours(partials: DataFrame, use: Column, node_count: Column, node_type_count: Column) -> DataFrame:
    """Merge the partial sums for which ``use`` holds into one row per cluster and hour."""

    def used(column: str) -> Column:
        return F.when(use, F.col(column))

    merged = partials.groupBy(*HOUR_KEY).agg(
        F.sum(used("cpu_sum")).alias("cpu_sum"),
        F.sum(used("cpu_n")).alias("cpu_n"),
        F.max(used("cpu_max")).alias("peak_cpu_pct"),
        F.sum(used("mem_sum")).alias("mem_sum"),
        F.sum(used("mem_n")).alias("mem_n"),
        F.max(used("mem_max")).alias("peak_mem_pct"),
        node_count.alias("node_count"),
        node_type_count.alias("node_type_count"),
    )
    return merged.select(
        *HOUR_KEY,
        ratio(F.col("cpu_sum"), F.col("cpu_n")).alias("avg_cpu_pct"),
        "peak_cpu_pct",
        ratio(F.col("mem_sum"), F.col("mem_n")).alias("avg_mem_pct"),
        "peak_mem_pct",
        "node_count",
        "node_type_count",
    )


def cluster_hourly_utilization(nodes: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Two distinct counts beside sums, by two grouping sets: hours per node, which carry
    the sums, and hours per node type. Both shrink before the shuffle, a busy cluster is
    spread over its nodes, and each count is then a count of groups."""
    recent = nodes.where(clock.times_since("start_time", clock.midnight_ago(cfg.utilization_days)))
    samples = recent.withColumn("hour_window", F.date_trunc("hour", "start_time"))
    key = [F.col(c) for c in HOUR_KEY]
    node, kind = F.col("instance_id"), F.col("node_type")
    groups = samples.groupingSets([[*key, node], [*key, kind]], *key, node, kind).agg(
        (F.grouping("instance_id") == 0).alias("per_node"), *_sums()
    )
    per_node = F.col("per_node")
    return _cluster_hours(
        groups, per_node, count_where(per_node & node.isNotNull()), count_where(~per_node & kind.isNotNull())
    )


def node_hours(samples: DataFrame, hour: Column) -> DataFrame:
    """One row per node, node type and hour, which a stream can emit and batches can
    merge later."""
    return samples.groupBy(*CLUSTER_KEY, hour.alias("hour_window"), "instance_id", "node_type").agg(*_sums())


def summed_node_hours(partials: DataFrame) -> DataFrame:
    """Several node hours of one node, type and hour become one."""
    sums = [F.sum(c).alias(c) for c in ("cpu_sum", "cpu_n", "mem_sum", "mem_n")] + [F.max(c).alias(c) for c in ("cpu_max", "mem_max")]
    merged = partials.groupBy(*HOUR_KEY, "instance_id", "node_type").agg(*sums)
    return merged.select(*partials.columns)


def merge_node_hours(partials: DataFrame) -> DataFrame:
    """Cluster hours from node hours."""
    return _cluster_hours(
        partials, F.lit(True), F.count_distinct("instance_id"), F.count_distinct("node_type")
    )


# --- daily job cost and its trend ------------------------------------------------


def job_daily_cost(usage: DataFrame, prices: DataFrame, jobs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    recent = usage.where(
        F.col("job_id").isNotNull() & clock.dates_since("usage_date", clock.date_ago(cfg.cost_days))
    )
    daily = (
        priced_usage(recent, prices, cfg)
        .groupBy(*JOB_KEY, "usage_date")
        .agg(F.sum("cost_usd").alias("daily_cost_usd"))
    )
    # Names are joined to at most one row per job and day, not to raw usage.
    return with_job_name(daily, jobs).select(*JOB_KEY, "job_name", "usage_date", "daily_cost_usd")


def with_trend(daily: DataFrame, trailing: Window, preceding: Window) -> DataFrame:
    baseline = F.avg("daily_cost_usd").over(preceding)
    return daily.select(
        *JOB_KEY,
        "job_name",
        "usage_date",
        "daily_cost_usd",
        F.avg("daily_cost_usd").over(trailing).alias("rolling_14d_avg"),
        (ratio(F.col("daily_cost_usd"), baseline) - 1).alias("cost_growth_pct"),
    )


def job_cost_trend(usage: DataFrame, prices: DataFrame, jobs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Daily cost, its mean over 14 rows, and its growth over the mean of the 7 rows
    before. Frames count days with spend; ``job_cost_trend_calendar`` counts days."""
    by_day = Window.partitionBy(*JOB_KEY).orderBy("usage_date")
    daily = job_daily_cost(usage, prices, jobs, clock, cfg)
    return with_trend(daily, by_day.rowsBetween(-13, 0), by_day.rowsBetween(-7, -1))


def job_cost_trend_calendar(
    usage: DataFrame, prices: DataFrame, jobs: DataFrame, clock: Clock, cfg: Config
) -> DataFrame:
    """As ``job_cost_trend``, with frames of calendar days."""
    epoch_day = F.datediff(F.col("usage_date"), F.lit("1970-01-01").cast("date"))
    by_day = Window.partitionBy(*JOB_KEY).orderBy(epoch_day)
    daily = job_daily_cost(usage, prices, jobs, clock, cfg)
    return with_trend(daily, by_day.rangeBetween(-13, 0), by_day.rangeBetween(-7, -1))


# --- job runs and health -----------------------------------------------------------


def collapse_periods(periods: DataFrame) -> DataFrame:
    """One row per run. The state is the greatest of the run's states."""
    return periods.groupBy(*RUN_KEY).agg(
        F.min("period_start_time").alias("run_start"),
        F.max("period_end_time").alias("run_end"),
        F.max("result_state").alias("result_state"),
    )


def job_runs_collapsed(runs: DataFrame, clock: Clock, days: int) -> DataFrame:
    return collapse_periods(runs.where(clock.times_since("period_start_time", clock.midnight_ago(days))))


def job_runs_last_state(runs: DataFrame, clock: Clock, days: int) -> DataFrame:
    """Variant: the state of the last period that has one."""
    recent = runs.where(clock.times_since("period_start_time", clock.midnight_ago(days)))
    stated_end = F.when(F.col("result_state").isNotNull(), F.col("period_end_time"))
    return recent.groupBy(*RUN_KEY).agg(
        F.min("period_start_time").alias("run_start"),
        F.max("period_end_time").alias("run_end"),
        F.max_by("result_state", stated_end).alias("result_state"),
    )


def completed_runs(runs: DataFrame, clock: Clock, days: int) -> DataFrame:
    """Runs with a state and a plausible end, and their whole seconds."""
    collapsed = job_runs_collapsed(runs, clock, days)
    done = F.col("result_state").isNotNull() & (F.col("run_end") >= F.col("run_start"))
    return collapsed.where(done).withColumn(
        "duration_secs", F.timestamp_diff("SECOND", F.col("run_start"), F.col("run_end"))
    )


def run_outcomes(periods: DataFrame) -> DataFrame:
    """One row per run with flags in place of its state, for queries that only count.

    Flags aggregate by hashing, while the greatest of strings needs a sort of all
    periods on both sides of the shuffle. ``FAILED`` is the greatest state of a run if
    it occurs and no greater one does.
    """
    state = F.col("result_state")
    beaten = F.coalesce(F.bool_or(state > "FAILED"), F.lit(False))
    return periods.groupBy(*RUN_KEY).agg(
        F.min("period_start_time").alias("run_start"),
        F.max("period_end_time").alias("run_end"),
        (F.count(state) > 0).alias("finished"),
        (F.coalesce(F.bool_or(state == "FAILED"), F.lit(False)) & ~beaten).alias("failed"),
    )


def finished_runs(runs: DataFrame, clock: Clock, days: int) -> DataFrame:
    """Runs that have a state, from the periods started in the last ``days``."""
    recent = runs.where(clock.times_since("period_start_time", clock.midnight_ago(days)))
    return run_outcomes(recent).where("finished").drop("finished")


def timed_runs(runs: DataFrame, clock: Clock, days: int) -> DataFrame:
    """The runs of ``completed_runs`` with a failure flag in place of the state."""
    plausible = F.col("run_end") >= F.col("run_start")
    return finished_runs(runs, clock, days).where(plausible).withColumn(
        "duration_secs", F.timestamp_diff("SECOND", F.col("run_start"), F.col("run_end"))
    )


def job_health(runs: DataFrame, jobs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    per_job = (
        timed_runs(runs, clock, cfg.health_lookback_days)
        .groupBy(*JOB_KEY)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            count_where(F.col("failed")).alias("failed_runs"),
            F.avg("duration_secs").alias("avg_duration_secs"),
            F.stddev_samp("duration_secs").alias("stddev_duration"),
            F.max("duration_secs").cast("double").alias("max_duration_secs"),
        )
    )
    return with_job_name(per_job, jobs).select(
        *JOB_KEY,
        "job_name",
        "total_runs",
        "failed_runs",
        steady_round(ratio(F.col("failed_runs"), F.col("total_runs")), 4).alias("failure_rate"),
        "avg_duration_secs",
        "stddev_duration",
        "max_duration_secs",
    )


def stamped(feature: DataFrame, clock: Clock) -> DataFrame:
    """Add the refresh time."""
    return feature.withColumn("updated_at", clock.now)
