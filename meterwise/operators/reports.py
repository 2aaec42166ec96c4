"""Stable report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import count_where, ratio, steady_round
from meterwise.operators.budget import month_usage
from meterwise.operators.features import finished_runs
from meterwise.operators.validation import slow_latest_runs
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY, latest_clusters, live_clusters, priced_usage


def _percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


# --- cost ---------------------------------------------------------------------------


def cost_monthly_summary(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    recent = usage.where(clock.dates_since("usage_date", clock.months_ago(6)))
    # One row per month, workspace and job before the two distinct counts.
    per_job = (
        priced_usage(recent, prices, cfg)
        .groupBy(F.date_trunc("month", "usage_date").alias("month"), *JOB_KEY)
        .agg(F.sum("cost_usd").alias("cost_usd"))
    )
    return per_job.groupBy("month").agg(
        steady_round(F.sum("cost_usd"), 2).alias("total_spend_usd"),
        F.count_distinct("workspace_id").alias("workspaces"),
        F.count_distinct("job_id").alias("unique_jobs"),
    )


def cost_current_month_trajectory(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Daily spend, running total and 7-row mean, both of the rounded daily values."""
    daily = (
        priced_usage(month_usage(usage, clock), prices, cfg)
        .groupBy("usage_date")
        .agg(steady_round(F.sum("cost_usd"), 2).alias("daily_spend"))
    )
    # One partition, of at most 31 rows: the days of one month.
    by_day = Window.orderBy("usage_date")
    return daily.select(
        "usage_date",
        "daily_spend",
        F.sum("daily_spend").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_spend"),
        F.avg("daily_spend").over(by_day.rowsBetween(-6, 0)).alias("rolling_7d_avg"),
    )


def cost_top_drivers_mtd(trend: DataFrame, clock: Clock, limit: int = 10) -> DataFrame:
    per_name = (
        trend.where(clock.dates_since("usage_date", clock.month_start))
        .groupBy("job_name", "workspace_id")
        .agg(
            steady_round(F.sum("daily_cost_usd"), 2).alias("mtd_cost"),
            steady_round(F.avg("daily_cost_usd"), 2).alias("avg_daily_cost"),
            steady_round(F.max("cost_growth_pct") * 100, 1).alias("max_growth_pct"),
        )
    )
    return per_name.orderBy(F.desc("mtd_cost"), F.asc_nulls_first("job_name"), "workspace_id").limit(limit)


def cost_by_sku(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config, limit: int = 15) -> DataFrame:
    per_sku = (
        priced_usage(month_usage(usage, clock), prices, cfg)
        .groupBy("sku_name", "billing_origin_product")
        .agg(
            steady_round(F.sum("cost_usd"), 2).alias("mtd_spend"),
            steady_round(F.sum("usage_quantity"), 0).alias("total_dbus"),
        )
    )
    return per_sku.orderBy(F.desc("mtd_spend"), "sku_name", "billing_origin_product").limit(limit)


# --- clusters -----------------------------------------------------------------------


def _last_week(hourly: DataFrame, clock: Clock) -> DataFrame:
    return hourly.where(clock.times_since("hour_window", clock.midnight_ago(7)))


def cluster_utilization_heatmap(hourly: DataFrame, clock: Clock) -> DataFrame:
    return (
        _last_week(hourly, clock)
        .groupBy(
            "cluster_id", F.to_date("hour_window").alias("day"), F.hour("hour_window").alias("hour_of_day")
        )
        .agg(
            steady_round(F.avg("avg_cpu_pct"), 1).alias("avg_cpu"),
            steady_round(F.avg("avg_mem_pct"), 1).alias("avg_mem"),
        )
    )


def cluster_over_provisioned(hourly: DataFrame, clusters: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    means = (
        _last_week(hourly, clock)
        .groupBy(*CLUSTER_KEY)
        .agg(
            F.avg("avg_cpu_pct").alias("cpu"),
            F.avg("avg_mem_pct").alias("mem"),
            F.avg("node_count").alias("nodes"),
        )
        .where((F.col("cpu") < cfg.low_cpu_pct) & (F.col("mem") < cfg.low_mem_pct))
    )
    newest = latest_clusters(clusters).select(
        *CLUSTER_KEY, "cluster_name", "worker_node_type", "min_workers", "max_workers"
    )
    return means.join(newest, CLUSTER_KEY, "left").select(
        *CLUSTER_KEY,
        "cluster_name",
        "worker_node_type",
        "min_workers",
        "max_workers",
        steady_round(F.col("cpu"), 1).alias("avg_cpu_7d"),
        steady_round(F.col("mem"), 1).alias("avg_mem_7d"),
        steady_round(F.col("nodes"), 1).alias("avg_nodes"),
    )


def cluster_idle_summary(hourly: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    idle = F.col("avg_cpu_pct") < cfg.idle_cpu_pct
    return (
        _last_week(hourly, clock)
        .groupBy("workspace_id")
        .agg(
            F.count_distinct("cluster_id").alias("total_clusters"),
            count_where(idle).alias("idle_observations"),
            steady_round(F.avg("node_count"), 1).alias("avg_nodes_across_all"),
            steady_round(
                _percent(F.sum(F.when(idle, F.col("node_count")).otherwise(0)), F.sum("node_count")), 1
            ).alias("idle_node_pct"),
        )
    )


def cluster_size_distribution(clusters: DataFrame) -> DataFrame:
    size = F.col("max_workers")
    bucket = (
        F.when(size <= 2, "Small (1-2)")
        .when(size <= 8, "Medium (3-8)")
        .when(size <= 20, "Large (9-20)")
        .otherwise("XLarge (20+)")
    )
    return (
        live_clusters(clusters)
        .groupBy(bucket.alias("cluster_size_bucket"))
        .agg(F.count_distinct("cluster_id").alias("cluster_count"))
    )


# --- reliability --------------------------------------------------------------------


def job_reliability_overall(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.sum("total_runs").alias("total_runs"),
        F.sum("failed_runs").alias("total_failures"),
        steady_round((1 - ratio(F.sum("failed_runs"), F.sum("total_runs"))) * 100, 2).alias(
            "overall_success_rate_pct"
        ),
        steady_round(F.avg("failure_rate") * 100, 2).alias("avg_failure_rate_pct"),
    )


def job_daily_failure_trend(runs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Finished runs and failures by the date on which the run started."""
    failed = count_where(F.col("failed"))
    return finished_runs(runs, clock, cfg.health_lookback_days).groupBy(F.to_date("run_start").alias("run_date")).agg(
        F.count(F.lit(1)).alias("total_runs"),
        failed.alias("failures"),
        steady_round(failed * 100 / F.count(F.lit(1)), 2).alias("failure_rate_pct"),
    )


def _minutes(seconds: str) -> Column:
    return steady_round(F.col(seconds) / 60, 1)


def job_most_unreliable(health: DataFrame, cfg: Config, limit: int = 15) -> DataFrame:
    ranked = health.where(F.col("total_runs") >= cfg.min_runs_to_rank)
    return ranked.orderBy(F.desc_nulls_last("failure_rate"), *JOB_KEY).limit(limit).select(
        "job_name",
        "workspace_id",
        "total_runs",
        "failed_runs",
        steady_round(F.col("failure_rate") * 100, 1).alias("failure_rate_pct"),
        _minutes("avg_duration_secs").alias("avg_duration_min"),
        _minutes("max_duration_secs").alias("max_duration_min"),
    )


def job_sla_breaches(health: DataFrame, cfg: Config, limit: int = 15) -> DataFrame:
    """Jobs whose mean duration exceeds the SLA. Their estimated breaches are all
    their runs; ``job_sla_breach_runs`` counts the runs that did breach."""
    slow = health.where(F.col("avg_duration_secs") > cfg.sla_minutes * 60)
    return slow.orderBy(F.desc("avg_duration_secs"), *JOB_KEY).limit(limit).select(
        "job_name",
        "workspace_id",
        "total_runs",
        _minutes("avg_duration_secs").alias("avg_duration_min"),
        _minutes("max_duration_secs").alias("max_duration_min"),
        F.col("total_runs").alias("est_sla_breaches"),
    )


def job_sla_breach_runs(completed: DataFrame, cfg: Config) -> DataFrame:
    """Variant: per job, the runs whose own duration exceeds the SLA."""
    breach = F.col("duration_secs") > cfg.sla_minutes * 60
    return (
        completed.groupBy(*JOB_KEY)
        .agg(F.count(F.lit(1)).alias("total_runs"), count_where(breach).alias("sla_breaches"))
        .where(F.col("sla_breaches") > 0)
    )


def job_duration_anomalies(
    health: DataFrame, runs: DataFrame, clock: Clock, cfg: Config, limit: int = 15
) -> DataFrame:
    slow = slow_latest_runs(health, runs, clock, cfg)
    return slow.orderBy(F.desc("z"), *JOB_KEY).limit(limit).select(
        "job_name",
        "workspace_id",
        _minutes("latest_secs").alias("latest_duration_min"),
        _minutes("avg_duration_secs").alias("avg_duration_min"),
        _minutes("threshold_secs").alias("threshold_min"),
        steady_round(F.col("z"), 1).alias("z_score"),
    )


# --- actions ------------------------------------------------------------------------


def _this_month(log: DataFrame, clock: Clock) -> DataFrame:
    return log.where(clock.times_since("action_timestamp", clock.month_start_ts))


def _with_status(status: str) -> Column:
    return count_where(F.col("status") == status)


def _savings(places: int = 2) -> Column:
    return steady_round(F.sum("projected_savings"), places)


def cost_savings_captured(log: DataFrame, clock: Clock) -> DataFrame:
    return _this_month(log, clock).groupBy("skill_name", "action_type").agg(
        F.count(F.lit(1)).alias("actions_count"),
        _with_status("applied").alias("applied_count"),
        _savings().alias("total_projected_savings"),
    )


def agent_activity_mtd(log: DataFrame, clock: Clock) -> DataFrame:
    return _this_month(log, clock).groupBy("skill_name", "action_type").agg(
        F.count(F.lit(1)).alias("total_actions"),
        _with_status("applied").alias("applied"),
        _with_status("proposed").alias("proposed"),
        _with_status("rejected").alias("rejected"),
        _savings().alias("total_projected_savings"),
    )


def agent_monthly_savings_trend(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("month", "action_timestamp").alias("month")).agg(
        _savings().alias("total_savings"),
        F.count(F.lit(1)).alias("total_actions"),
        _with_status("applied").alias("applied_actions"),
    )


def agent_recent_actions(log: DataFrame, limit: int = 50) -> DataFrame:
    newest = log.orderBy(F.desc_nulls_last("action_timestamp"), "action_id").limit(limit)
    return newest.select(
        "action_timestamp",
        "skill_name",
        "action_type",
        "target_name",
        "description",
        steady_round(F.col("projected_savings"), 2).alias("savings"),
        "status",
    )


def agent_savings_by_skill(log: DataFrame, clock: Clock) -> DataFrame:
    return _this_month(log, clock).groupBy("skill_name").agg(
        _savings().alias("total_savings"), F.count(F.lit(1)).alias("action_count")
    )


def monthly_digest(log: DataFrame, clock: Clock) -> DataFrame:
    # Per target and skill first, so that the two distinct counts run on few rows.
    per_target = _this_month(log, clock).groupBy("target_id", "skill_name").agg(
        F.count(F.lit(1)).alias("n"),
        _with_status("applied").alias("applied"),
        F.sum("projected_savings").alias("savings"),
    )
    return per_target.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_actions"),
        F.sum("applied").alias("applied"),
        steady_round(F.sum("savings"), 0).alias("total_savings"),
        F.count_distinct("target_id").alias("unique_targets"),
        F.count_distinct("skill_name").alias("skills_used"),
    )


# Fixed value: the wording of the digest.
DIGEST_TEXT = (
    "This month, %d actions were recorded across %d resources using %d skills. "
    "%d action(s) were applied. Projected savings: $%,d"
)
EMPTY_DIGEST = "No agent actions recorded this month yet."


def digest_text(digest: DataFrame) -> DataFrame:
    text = F.format_string(
        DIGEST_TEXT, "total_actions", "unique_targets", "skills_used", "applied",
        F.coalesce(F.col("total_savings"), F.lit(0.0)).cast("long"),
    )
    return digest.select(F.when(F.col("total_actions") > 0, text).otherwise(EMPTY_DIGEST).alias("digest"))
