"""Short lists that accompany the features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import ratio, steady_round
from meterwise.functions.versioning import top_per_key
from meterwise.operators.features import timed_runs
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY


def underutilized_clusters(hourly: DataFrame, clock: Clock, cfg: Config, limit: int = 20) -> DataFrame:
    means = (
        hourly.where(clock.times_since("hour_window", clock.midnight_ago(7)))
        .groupBy(*CLUSTER_KEY)
        .agg(
            F.count(F.lit(1)).alias("hours_observed"),
            F.avg("avg_cpu_pct").alias("cpu"),
            F.avg("avg_mem_pct").alias("mem"),
            F.avg("node_count").alias("nodes"),
            F.avg("node_type_count").alias("types"),
        )
        .where((F.col("cpu") < cfg.low_cpu_pct) & (F.col("mem") < cfg.low_mem_pct))
    )
    return means.orderBy("cpu", *CLUSTER_KEY).limit(limit).select(
        *CLUSTER_KEY,
        "hours_observed",
        steady_round(F.col("cpu"), 1).alias("avg_cpu"),
        steady_round(F.col("mem"), 1).alias("avg_mem"),
        steady_round(F.col("nodes"), 1).alias("avg_nodes"),
        steady_round(F.col("types"), 1).alias("avg_node_types"),
    )


def top_cost_spikes(trend: DataFrame, clock: Clock, cfg: Config, limit: int = 20) -> DataFrame:
    spikes = trend.where(
        clock.dates_since("usage_date", clock.date_ago(7)) & (F.col("cost_growth_pct") > cfg.spike_growth)
    )
    return spikes.orderBy(F.desc("cost_growth_pct"), *JOB_KEY, "usage_date").limit(limit).select(
        *JOB_KEY,
        "job_name",
        "usage_date",
        steady_round(F.col("daily_cost_usd"), 2).alias("daily_cost"),
        steady_round(F.col("rolling_14d_avg"), 2).alias("avg_14d"),
        steady_round(F.col("cost_growth_pct") * 100, 1).alias("growth_pct"),
    )


def unreliable_jobs(health: DataFrame, cfg: Config, limit: int = 20) -> DataFrame:
    ranked = health.where(F.col("total_runs") >= cfg.min_runs_to_rank)
    return ranked.orderBy(F.desc_nulls_last("failure_rate"), *JOB_KEY).limit(limit).select(
        *JOB_KEY,
        "job_name",
        "total_runs",
        "failed_runs",
        steady_round(F.col("failure_rate") * 100, 1).alias("failure_rate_pct"),
        steady_round(F.col("avg_duration_secs"), 0).alias("avg_duration_s"),
        steady_round(F.col("stddev_duration"), 0).alias("stddev_s"),
        steady_round(F.col("max_duration_secs"), 0).alias("max_duration_s"),
    )


def slow_latest_runs(health: DataFrame, runs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Jobs whose latest completed run of the last 7 days lies more than
    ``anomaly_sigma`` deviations above their mean, with unrounded measures."""
    latest = top_per_key(
        timed_runs(runs, clock, 7), JOB_KEY, [F.desc("run_start"), F.desc("run_id")]
    ).select(*JOB_KEY, F.col("duration_secs").alias("latest_secs"))
    threshold = F.col("avg_duration_secs") + cfg.anomaly_sigma * F.col("stddev_duration")
    return (
        health.join(latest, JOB_KEY)
        .withColumn("threshold_secs", threshold)
        .where((F.col("stddev_duration") > 0) & (F.col("latest_secs") > F.col("threshold_secs")))
        .withColumn(
            "z", ratio(F.col("latest_secs") - F.col("avg_duration_secs"), F.col("stddev_duration"))
        )
    )


def latest_run_anomalies(
    health: DataFrame, runs: DataFrame, clock: Clock, cfg: Config, limit: int = 20
) -> DataFrame:
    slow = slow_latest_runs(health, runs, clock, cfg)
    return slow.orderBy(F.desc("z"), *JOB_KEY).limit(limit).select(
        *JOB_KEY,
        "job_name",
        F.col("latest_secs").alias("latest_duration_s"),
        steady_round(F.col("avg_duration_secs"), 0).alias("avg_s"),
        steady_round(F.col("threshold_secs"), 0).alias("threshold_s"),
    )
