"""Answers to common questions that no report view gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import count_where, ratio, steady_round
from meterwise.functions.ordering import previous_value
from meterwise.functions.versioning import top_per_key
from meterwise.operators.budget import month_usage, with_budget
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY, priced_usage, with_job_name


def month_over_month_to_date(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Spend of this month so far against the same days of the month before."""
    last_start = F.add_months(clock.month_start, -1)
    last_end = F.least(F.add_months(clock.today, -1), F.date_sub(clock.month_start, 1))
    this_month = clock.dates_since("usage_date", clock.month_start)
    last_month = F.col("usage_date").between(last_start, last_end)
    per_workspace = (
        priced_usage(usage.where(this_month | last_month), prices, cfg)
        .groupBy("workspace_id")
        .agg(
            F.sum(F.when(this_month, F.col("cost_usd"))).alias("now"),
            F.sum(F.when(last_month, F.col("cost_usd"))).alias("before"),
        )
    )
    return per_workspace.select(
        "workspace_id",
        steady_round(F.col("now"), 2).alias("this_month_spend"),
        steady_round(F.col("before"), 2).alias("last_month_spend"),
        steady_round((ratio(F.col("now"), F.col("before")) - 1) * 100, 1).alias("change_pct"),
    )


def cumulative_vs_budget(trajectory: DataFrame, cfg: Config) -> DataFrame:
    budget = F.lit(cfg.default_budget)
    return trajectory.select(
        "usage_date",
        steady_round(F.col("cumulative_spend"), 2).alias("cumulative_spend"),
        budget.alias("budget"),
        steady_round(F.col("cumulative_spend") / budget * 100, 1).alias("budget_used_pct"),
        steady_round(budget - F.col("cumulative_spend"), 2).alias("remaining"),
    )


def workspace_spend_rank(daily_spend: DataFrame) -> DataFrame:
    totals = daily_spend.groupBy("workspace_id").agg(steady_round(F.sum("daily_cost_usd"), 2).alias("mtd_spend"))
    return totals.orderBy(F.desc("mtd_spend"), "workspace_id")


def cluster_resizes(clusters: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    """Versions of the last ``days`` whose size differs from the version before."""
    size = ["min_workers", "max_workers"]
    since = clock.midnight_ago(days)
    order = ["change_time", "cluster_name", *size]
    columns = [*CLUSTER_KEY, *order]
    recent = clusters.where(clock.times_since("change_time", since)).select(*columns)
    # Of the older versions only the newest one per cluster can be a predecessor.
    earlier = top_per_key(
        clusters.where(F.col("change_time") < since).select(*columns), CLUSTER_KEY, [F.desc(c) for c in order]
    )
    sized = previous_value(
        earlier.unionByName(recent), CLUSTER_KEY, order, F.date_trunc("hour", "change_time"), size, "before"
    )
    resized = ~(
        F.col("min_workers").eqNullSafe(F.col("before.min_workers"))
        & F.col("max_workers").eqNullSafe(F.col("before.max_workers"))
    )
    return sized.where((F.col("change_time") >= since) & F.col("before").isNotNull() & resized).select(
        *CLUSTER_KEY,
        "cluster_name",
        "change_time",
        F.col("before.min_workers").alias("old_min"),
        F.col("before.max_workers").alias("old_max"),
        F.col("min_workers").alias("new_min"),
        F.col("max_workers").alias("new_max"),
    )


def jobs_above_failure_rate(health: DataFrame, rate: float = 0.10) -> DataFrame:
    return health.where(F.col("failure_rate") > rate).select(
        *JOB_KEY, "job_name", "total_runs", "failed_runs", "failure_rate"
    )


def job_duration_percentiles(completed: DataFrame) -> DataFrame:
    """Exact percentiles per job. The aggregate keeps a count per distinct number of
    seconds, not a list of runs, and merges such counts before the shuffle."""
    spread = completed.groupBy(*JOB_KEY).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.percentile("duration_secs", [0.5, 0.9, 0.95, 0.99]).alias("p"),
        F.min("duration_secs").alias("min_secs"),
        F.max("duration_secs").alias("max_secs"),
    )
    return spread.select(
        *JOB_KEY,
        "total_runs",
        "min_secs",
        *[steady_round(F.col("p")[i], 2).alias(name) for i, name in enumerate(["p50", "p90", "p95", "p99"])],
        "max_secs",
    )


def budget_exhaustion_date(projection: DataFrame, budgets: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """The date on which the budget is used up at the mean daily spend so far. The
    rounded money columns of the projection are the inputs."""
    left = F.col("budget") - F.col("mtd_spend")
    days = F.greatest(F.lit(0).cast("long"), F.ceil(ratio(left, F.col("avg_daily_spend")))).cast("int")
    return with_budget(projection, budgets, cfg).select(
        "workspace_id",
        "mtd_spend",
        "avg_daily_spend",
        "budget",
        F.date_add(clock.today, days).alias("exhausted_on"),
    )


def budget_risk_rank(used: DataFrame) -> DataFrame:
    return used.orderBy(F.desc("budget_pct"), "workspace_id").select(
        "workspace_id", "linear_projection", "budget", steady_round(F.col("budget_pct"), 1).alias("budget_pct")
    )


def total_waste(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), steady_round(F.sum("weekly_savings"), 2).alias("weekly_savings")
    )


def cluster_job_profile(
    hourly: DataFrame, tasks: DataFrame, jobs: DataFrame, clock: Clock, cluster_id: str | None = None
) -> DataFrame:
    """Utilisation of a cluster, or of each, next to the jobs that ran on it in the last
    7 days."""
    recent_hours = hourly.where(clock.times_since("hour_window", clock.midnight_ago(7)))
    recent_tasks = tasks.where(clock.times_since("period_start_time", clock.midnight_ago(7)))
    if cluster_id is not None:
        recent_hours = recent_hours.where(F.col("cluster_id") == cluster_id)
        recent_tasks = recent_tasks.where(F.col("compute_id") == cluster_id)
    means = recent_hours.groupBy(*CLUSTER_KEY).agg(
        steady_round(F.avg("avg_cpu_pct"), 1).alias("avg_cpu"),
        steady_round(F.avg("avg_mem_pct"), 1).alias("avg_mem"),
        steady_round(F.avg("node_count"), 1).alias("avg_nodes"),
    )
    per_job = recent_tasks.groupBy(*JOB_KEY, F.col("compute_id").alias("cluster_id")).agg(
        F.count_distinct("run_id").alias("runs")
    )
    return with_job_name(means.join(per_job, CLUSTER_KEY), jobs).select(
        *CLUSTER_KEY, "avg_cpu", "avg_mem", "avg_nodes", "job_id", "job_name", "runs"
    )


def unreliable_and_expensive(
    trend: DataFrame, health: DataFrame, clock: Clock, cfg: Config, limit: int = 20
) -> DataFrame:
    """Jobs with at least ``min_runs_to_rank`` runs, by what their failures cost: month
    to date spend times failure rate."""
    spend = (
        trend.where(clock.dates_since("usage_date", clock.month_start))
        .groupBy(*JOB_KEY)
        .agg(F.sum("daily_cost_usd").alias("cost"))
    )
    both = health.where(F.col("total_runs") >= cfg.min_runs_to_rank).join(spend, JOB_KEY)
    return (
        both.withColumn("failed_cost", steady_round(F.col("cost") * F.col("failure_rate"), 2))
        .orderBy(F.desc("failed_cost"), *JOB_KEY)
        .limit(limit)
        .select(
            *JOB_KEY, "job_name", "failure_rate", steady_round(F.col("cost"), 2).alias("mtd_cost"), "failed_cost"
        )
    )


def workspace_comparison(
    daily_spend: DataFrame, hourly: DataFrame, health: DataFrame, clock: Clock
) -> DataFrame:
    """Spend, utilisation and failures of every workspace side by side; a workspace
    need not appear in all three."""
    parts = [
        daily_spend.groupBy("workspace_id").agg(F.sum("daily_cost_usd").alias("spend")),
        hourly.where(clock.times_since("hour_window", clock.midnight_ago(7)))
        .groupBy("workspace_id")
        .agg(F.avg("avg_cpu_pct").alias("cpu"), F.avg("avg_mem_pct").alias("mem")),
        health.groupBy("workspace_id").agg(F.sum("total_runs").alias("runs"), F.sum("failed_runs").alias("failed")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = rows.groupBy("workspace_id").agg(*[F.max(c).alias(c) for c in ("spend", "cpu", "mem", "runs", "failed")])
    return merged.select(
        "workspace_id",
        steady_round(F.col("spend"), 2).alias("mtd_spend"),
        steady_round(F.col("cpu"), 1).alias("avg_cpu"),
        steady_round(F.col("mem"), 1).alias("avg_mem"),
        F.col("runs").alias("total_runs"),
        F.col("failed").alias("failed_runs"),
        steady_round(ratio(F.col("failed"), F.col("runs")) * 100, 2).alias("failure_rate_pct"),
    )


def applied_ratio(log: DataFrame) -> DataFrame:
    counts = log.agg(
        count_where(F.col("status") == "applied").alias("applied"),
        count_where(F.col("status") == "proposed").alias("proposed"),
    )
    return counts.select(
        "applied", "proposed", steady_round(ratio(F.col("applied"), F.col("proposed")), 4).alias("applied_to_proposed")
    )
