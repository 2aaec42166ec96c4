"""Compute that is paid for and not needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import or_default, steady_round, text_or
from meterwise.operators.actions import action_rows
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY, latest_clusters, live_clusters, with_job_name

# Category names in the order that settles ties, and the wording.
CATEGORY_ORDER = ["wrong_compute", "idle_cluster", "zero_tasks"]
WRONG_COMPUTE_TEXT = "Migrate '%s' from all-purpose to job compute (%d runs/week)"
IDLE_TEXT = "Terminate idle cluster '%s' (idle %dh)"
ZERO_TASKS_TEXT = "Cluster '%s' is running with 0 active tasks — consider auto-terminate"


def jobs_on_interactive_compute(tasks: DataFrame, clusters: DataFrame, jobs: DataFrame, clock: Clock) -> DataFrame:
    """Jobs that ran on an interactive cluster in the last 7 days, one row per job and
    cluster, with the job's number of runs on such clusters."""
    interactive = (
        latest_clusters(clusters)
        .where(F.col("cluster_source") == "UI")
        .select(*CLUSTER_KEY, "cluster_name", "cluster_source")
    )
    recent = tasks.where(clock.times_since("period_start_time", clock.midnight_ago(7)))
    # Tasks shrink to distinct runs per cluster before they meet the clusters.
    run_clusters = recent.select(*JOB_KEY, "run_id", F.col("compute_id").alias("cluster_id")).distinct()
    on_interactive = run_clusters.join(interactive, CLUSTER_KEY)
    pairs = on_interactive.select(*JOB_KEY, "cluster_id", "cluster_name", "cluster_source").distinct()
    runs = on_interactive.groupBy(*JOB_KEY).agg(F.count_distinct("run_id").alias("recent_runs"))
    return with_job_name(pairs.join(runs, JOB_KEY), jobs).select(
        *JOB_KEY, "job_name", "cluster_id", "cluster_name", "cluster_source", "recent_runs"
    )


def idle_clusters(hourly: DataFrame, clusters: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Live clusters with low CPU in the last 24 hours, or no activity for
    ``idle_hours``, or none at all."""
    activity = (
        hourly.where(clock.times_since("hour_window", clock.hours_ago(24)))
        .groupBy(*CLUSTER_KEY)
        .agg(F.max("hour_window").alias("last_active_hour"), F.avg("avg_cpu_pct").alias("cpu"))
    )
    silent = F.col("last_active_hour").isNull()
    quiet = F.col("last_active_hour") < clock.hours_ago(cfg.idle_hours)
    return (
        live_clusters(clusters)
        .select(*CLUSTER_KEY, "cluster_name")
        .join(activity, CLUSTER_KEY, "left")
        .where(silent | quiet | (F.col("cpu") < cfg.idle_cpu_pct))
        .select(
            *CLUSTER_KEY,
            "cluster_name",
            "last_active_hour",
            steady_round(F.col("cpu"), 1).alias("recent_cpu"),
            F.timestamp_diff("HOUR", F.col("last_active_hour"), clock.now).alias("idle_hours"),
        )
    )


def zero_task_clusters(tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    """Live clusters on which no task started in the last 4 hours is still open."""
    open_tasks = tasks.where(
        clock.times_since("period_start_time", clock.hours_ago(4)) & F.col("period_end_time").isNull()
    )
    busy = open_tasks.select(F.col("compute_id").alias("cluster_id"), "workspace_id").distinct()
    return (
        live_clusters(clusters)
        .join(busy, CLUSTER_KEY, "left_anti")
        .select(*CLUSTER_KEY, "cluster_name", F.lit(0).cast("long").alias("active_tasks"))
    )


def waste_items(wrong: DataFrame, idle: DataFrame, no_tasks: DataFrame, cfg: Config) -> DataFrame:
    """The three kinds of waste in one list, with an estimated weekly saving."""
    job = text_or(F.col("job_name"), F.concat(F.lit("job_"), F.col("job_id")))
    cluster = text_or(F.col("cluster_name"), F.col("cluster_id"))
    hours = or_default(F.col("idle_hours"), F.lit(cfg.idle_hours).cast("long"))

    def item(rows: DataFrame, category: str, name, text, saving, target: str) -> DataFrame:
        # A job on several clusters is an item of each.
        return rows.select(
            F.lit(category).alias("category"),
            name.alias("target"),
            text.alias("description"),
            saving.cast("double").alias("weekly_savings"),
            "workspace_id",
            F.col(target).alias("target_id"),
            "cluster_id",
        )

    wrong_compute, idle_cluster, zero_tasks = CATEGORY_ORDER
    return (
        item(
            wrong, wrong_compute, job, F.format_string(WRONG_COMPUTE_TEXT, job, "recent_runs"),
            F.col("recent_runs") * cfg.weekly_saving_per_run, "job_id",
        )
        .unionByName(
            item(
                idle, idle_cluster, cluster, F.format_string(IDLE_TEXT, cluster, hours),
                hours * cfg.saving_per_idle_hour * cfg.days_per_week, "cluster_id",
            )
        )
        .unionByName(
            item(
                no_tasks, zero_tasks, cluster, F.format_string(ZERO_TASKS_TEXT, cluster),
                F.lit(cfg.weekly_saving_zero_tasks), "cluster_id",
            )
        )
    )


def top_waste_actions(items: DataFrame, cfg: Config, limit: int = 5) -> DataFrame:
    """The largest items, ranked. Ties keep the category order."""
    category = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    order = [F.desc("weekly_savings"), category.asc(), F.asc("target_id"), F.asc("workspace_id"), F.asc("description"), F.asc("cluster_id")]
    largest = items.orderBy(*order).limit(limit)
    # The window is over the rows left by the limit.
    return largest.select(
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"),
        *items.columns,
        steady_round(F.col("weekly_savings") * cfg.weeks_per_month, 2).alias("projected_savings"),
    )


def waste_actions(top: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    return action_rows(
        top,
        clock,
        skill="wasteful_compute_detector",
        kind="recommendation",
        workspace=F.col("workspace_id"),
        target=F.col("target_id"),
        name=F.col("target"),
        description=F.col("description"),
        savings=F.col("weekly_savings") * cfg.weeks_per_month,
        details=F.to_json(F.struct("category", "weekly_savings")),
        identity=(F.col("category"), F.col("target"), F.col("cluster_id")),
    )


def waste_summary(items: DataFrame, limit: int = 5) -> DataFrame:
    """Number of items, and the weekly total of the largest ``limit``."""
    per_value = items.groupBy("weekly_savings").agg(F.count(F.lit(1)).alias("n"))
    largest = items.orderBy(F.desc("weekly_savings")).limit(limit).agg(F.sum("weekly_savings").alias("v"))
    tagged = per_value.select("n", F.lit(None).cast("double").alias("v")).unionByName(
        largest.select(F.lit(None).cast("long").alias("n"), "v")
    )
    return tagged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("top_weekly_savings"),
    )
