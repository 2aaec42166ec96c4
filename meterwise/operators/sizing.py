"""Over-provisioned clusters and the size they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import or_default, steady_round, text_or, whole_number
from meterwise.operators.actions import action_rows
from meterwise.operators.versions import CLUSTER_KEY, latest_clusters

# Fixed value: the wording of a recommendation.
RECOMMENDATION = (
    "Cluster '%s' is over-provisioned (CPU: %s%%, MEM: %s%%). "
    "Recommend: %d-%d → %d-%d workers (~%d%% reduction, est. $%d/mo savings)."
)


def _is_low(cfg: Config) -> Column:
    return (F.col("avg_cpu_pct") < cfg.low_cpu_pct) & (F.col("avg_mem_pct") < cfg.low_mem_pct)


def _last_two_days(hourly: DataFrame, clock: Clock) -> DataFrame:
    return hourly.where(clock.times_since("hour_window", clock.hours_ago(48)))


def low_utilization_rows(hourly: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Every hour row of the last 48 hours with the number of low rows among it and
    the rows before, ``low_util_rows`` in all. A cluster has at most 49 such rows."""
    last_rows = Window.partitionBy(*CLUSTER_KEY).orderBy("hour_window").rowsBetween(1 - cfg.low_util_rows, 0)
    low = F.when(_is_low(cfg), 1).otherwise(0)
    return _last_two_days(hourly, clock).select(
        *CLUSTER_KEY,
        "hour_window",
        "avg_cpu_pct",
        "avg_mem_pct",
        "node_count",
        F.sum(low).over(last_rows).alias("consecutive_low_hours"),
    )


def low_utilization_streaks(hourly: DataFrame, clock: Clock, cfg: Config, min_hours: int | None = None) -> DataFrame:
    """Variant: runs of low hours without a gap, at least ``min_hours`` long."""
    low = _last_two_days(hourly, clock).where(_is_low(cfg))
    position = F.row_number().over(Window.partitionBy(*CLUSTER_KEY).orderBy("hour_window"))
    # Along hours without a gap, hour minus position stays the same.
    island = F.unix_timestamp("hour_window") - position * 3600
    streaks = low.withColumn("_island", island).groupBy(*CLUSTER_KEY, "_island").agg(
        F.min("hour_window").alias("streak_start"),
        F.max("hour_window").alias("streak_end"),
        F.count(F.lit(1)).alias("streak_hours"),
    )
    least = cfg.low_util_rows if min_hours is None else min_hours
    return streaks.where(F.col("streak_hours") >= least).drop("_island")


def overprovisioned_clusters(hourly: DataFrame, clusters: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Clusters whose low-row counter reached its full length, with their newest
    configuration; dropped if there is none."""
    candidates = (
        low_utilization_rows(hourly, clock, cfg)
        .groupBy(*CLUSTER_KEY)
        .agg(
            steady_round(F.avg("avg_cpu_pct"), 1).alias("avg_cpu"),
            steady_round(F.avg("avg_mem_pct"), 1).alias("avg_mem"),
            steady_round(F.avg("node_count"), 1).alias("avg_nodes"),
            F.max("consecutive_low_hours").alias("max_consec_low_hours"),
        )
        .where(F.col("max_consec_low_hours") >= cfg.low_util_rows)
    )
    newest = latest_clusters(clusters).select(
        *CLUSTER_KEY, "cluster_name", "cluster_source", "worker_node_type", "min_workers", "max_workers"
    )
    return candidates.join(newest, CLUSTER_KEY)


def _with_current_size(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns(
        {
            "current_min": or_default(F.col("min_workers"), F.lit(1)).cast("long"),
            "current_max": or_default(F.col("max_workers"), F.floor("avg_nodes")).cast("long"),
        }
    )


def right_sizing(candidates: DataFrame, cfg: Config) -> DataFrame:
    """The size at which the busier of CPU and memory would reach the target, for
    clusters that it makes smaller."""
    load = F.greatest("avg_cpu", "avg_mem") / cfg.sizing_target_pct
    sized = _with_current_size(candidates).withColumn(
        "optimal_max", F.greatest(F.lit(1).cast("long"), F.floor(F.col("current_max") * load))
    )
    sized = sized.withColumn("optimal_min", F.greatest(F.lit(1).cast("long"), F.floor(F.col("optimal_max") / 2)))
    reduction = F.when(
        F.col("current_max") > 0, (F.col("current_max") - F.col("optimal_max")) / F.col("current_max")
    ).otherwise(0.0)
    sized = sized.withColumn("reduction_pct", reduction)
    monthly = F.col("reduction_pct") * F.col("current_max") * cfg.hours_per_month * cfg.worker_hour_rate
    return sized.withColumn("estimated_monthly_savings", monthly).where(F.col("reduction_pct") > 0)


def right_sizing_p95(hourly: DataFrame, candidates: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Variant: the fewest workers that cover the 95th percentile of the busier
    measure plus headroom. Percentiles are over at most 49 hour rows per cluster."""
    peaks = (
        _last_two_days(hourly, clock)
        .groupBy(*CLUSTER_KEY)
        .agg(
            F.percentile("avg_cpu_pct", 0.95).alias("p95_cpu"),
            F.percentile("avg_mem_pct", 0.95).alias("p95_mem"),
        )
    )
    need = F.greatest("p95_cpu", "p95_mem") / 100 * (1 + cfg.sizing_headroom_pct / 100)
    workers = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("current_max") * need - F.lit(1e-9)))
    return (
        _with_current_size(candidates)
        .join(peaks, CLUSTER_KEY)
        .select(*CLUSTER_KEY, "cluster_name", "p95_cpu", "p95_mem", "current_max", workers.alias("optimal_max"))
    )


def right_sizing_actions(sized: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Proposals, or already applied changes where no approval is required. Carrying
    out the change is the caller's business."""
    name = text_or(F.col("cluster_name"), F.col("cluster_id"))
    description = F.format_string(
        RECOMMENDATION,
        name,
        F.col("avg_cpu").cast("string"),
        F.col("avg_mem").cast("string"),
        "current_min",
        "current_max",
        "optimal_min",
        "optimal_max",
        whole_number(F.col("reduction_pct") * 100),
        whole_number(F.col("estimated_monthly_savings")),
    )
    details = F.to_json(
        F.struct(
            "current_min",
            "current_max",
            F.col("optimal_min").alias("recommended_min"),
            F.col("optimal_max").alias("recommended_max"),
            F.col("avg_cpu").alias("avg_cpu_pct"),
            F.col("avg_mem").alias("avg_mem_pct"),
            steady_round(F.col("reduction_pct") * 100, 1).alias("reduction_pct"),
        )
    )
    return action_rows(
        sized,
        clock,
        skill="cluster_right_sizing",
        kind="recommendation" if cfg.require_approval else "auto_remediation",
        workspace=F.col("workspace_id"),
        target=F.col("cluster_id"),
        name=name,
        description=description,
        savings=F.col("estimated_monthly_savings"),
        details=details,
        status="proposed" if cfg.require_approval else "applied",
    )
