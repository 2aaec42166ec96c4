"""Cost spikes and their causes.

Causes are found for all spiking jobs at once: each cause is reduced to one row
per job and joined to the spikes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.joins import broadcast_if_few
from meterwise.functions.numeric import steady_round, text_or, whole_number
from meterwise.operators.actions import action_rows
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY

SPIKE_KEY = [*JOB_KEY, "usage_date"]

# The wording of an explanation.
CONFIG_CAUSE = "Cluster '%s' was reconfigured on %s — node type: %s, workers: %s-%s"
VOLUME_CAUSE = "DBU consumption increased %d%% (%d → %d DBUs week-over-week)"
COMPUTE_CAUSE = (
    "Job is running on ALL-PURPOSE compute (higher DBU rate) — migrating to job compute would reduce cost"
)
NO_CAUSE = "No specific root cause identified — review job configuration manually"
EXPLANATION = "Job '%s' cost %d%% more this week ($%d/day). Root cause(s): %s"


def cost_spikes(trend: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    recent = clock.dates_since("usage_date", clock.date_ago(3))
    return trend.where(recent & (F.col("cost_growth_pct") > cfg.spike_growth)).select(
        *JOB_KEY, "job_name", "usage_date", "daily_cost_usd", "rolling_14d_avg", "cost_growth_pct"
    )


def cluster_causes(clusters: DataFrame, clock: Clock) -> DataFrame:
    """Per cluster, in one pass: whether a version is interactive, and the newest version
    of the last 7 days (null if it did not change)."""
    newest = F.struct(
        F.negative(F.unix_micros("change_time")).alias("age"),
        "cluster_name",
        "worker_node_type",
        "min_workers",
        "max_workers",
        "change_time",
    )
    changed = clock.times_since("change_time", clock.midnight_ago(7))
    return clusters.groupBy(*CLUSTER_KEY).agg(
        F.coalesce(F.max(F.col("cluster_source") == "UI"), F.lit(False)).alias("interactive"),
        F.min(F.when(changed, newest)).alias("newest"),
    )


def job_causes(tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    """Per job, in one pass over its tasks: ``change``, the newest cluster version of the
    last 7 days among its clusters (null if none), and ``interactive``, whether it ran on an
    interactive cluster in that time. Tasks shrink to clusters per job before they meet
    the clusters."""
    recent = clock.times_since("period_start_time", clock.midnight_ago(7))
    used = tasks.groupBy(*JOB_KEY, F.col("compute_id").alias("cluster_id")).agg(F.max(recent).alias("recent"))
    change = F.struct("newest.age", "cluster_id", "newest")
    return (
        used.join(cluster_causes(clusters, clock), CLUSTER_KEY)
        .groupBy(*JOB_KEY)
        .agg(
            F.min(F.when(F.col("newest").isNotNull(), change)).alias("change"),
            F.coalesce(F.max(F.col("recent") & F.col("interactive")), F.lit(False)).alias("interactive"),
        )
    )


def _of_spiking_jobs(rows: DataFrame, spikes: DataFrame) -> DataFrame:
    return rows.join(spikes.select(*JOB_KEY), JOB_KEY, "left_semi")


def reconfigured_clusters(tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    """Per job, the newest cluster version of the last 7 days among its clusters."""
    version = ["cluster_name", "change_time", "worker_node_type", "min_workers", "max_workers"]
    return (
        job_causes(tasks, clusters, clock)
        .where(F.col("change").isNotNull())
        .select(*JOB_KEY, "change.cluster_id", *[F.col(f"change.newest.{c}").alias(c) for c in version])
    )


def spike_cause_config(spikes: DataFrame, tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    changed = reconfigured_clusters(_of_spiking_jobs(tasks, spikes), clusters, clock)
    return spikes.select(*SPIKE_KEY).join(changed, JOB_KEY).select(
        *SPIKE_KEY, "cluster_name", "change_time", "worker_node_type", "min_workers", "max_workers"
    )


def grown_volume(usage: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """Jobs whose quantity in the last 7 days exceeds that of the 7 days before by
    more than ``volume_growth_pct``."""
    this_week = F.col("usage_date") >= clock.date_ago(7)
    per_job = (
        usage.where(F.col("job_id").isNotNull() & clock.dates_since("usage_date", clock.date_ago(14)))
        .groupBy(*JOB_KEY)
        .agg(
            F.sum(F.when(this_week, F.col("usage_quantity"))).alias("this_week_dbus"),
            F.sum(F.when(~this_week, F.col("usage_quantity"))).alias("last_week_dbus"),
        )
    )
    both = (F.col("this_week_dbus") != 0) & (F.col("last_week_dbus") > 0)
    growth = (F.col("this_week_dbus") - F.col("last_week_dbus")) / F.col("last_week_dbus") * 100
    return per_job.where(both).withColumn("growth_pct", growth).where(F.col("growth_pct") > cfg.volume_growth_pct)


def spike_cause_volume(spikes: DataFrame, usage: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    grown = grown_volume(_of_spiking_jobs(usage, spikes), clock, cfg)
    return spikes.select(*SPIKE_KEY).join(grown, JOB_KEY).select(
        *SPIKE_KEY, "this_week_dbus", "last_week_dbus", "growth_pct"
    )


def jobs_on_interactive_clusters(tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    recent = tasks.where(clock.times_since("period_start_time", clock.midnight_ago(7)))
    return job_causes(recent, clusters, clock).where("interactive").select(*JOB_KEY)


def spike_cause_compute(spikes: DataFrame, tasks: DataFrame, clusters: DataFrame, clock: Clock) -> DataFrame:
    interactive = jobs_on_interactive_clusters(_of_spiking_jobs(tasks, spikes), clusters, clock)
    return spikes.select(*SPIKE_KEY).join(interactive, JOB_KEY, "left_semi")


def spike_explanations(
    spikes: DataFrame, usage: DataFrame, tasks: DataFrame, clusters: DataFrame, clock: Clock, cfg: Config
) -> DataFrame:
    """Each spike with its causes in a fixed order, and a sentence.

    ``spikes`` is read several times and counted: hand over a written table. Tasks and
    usage are reduced to spiking jobs before anything is shuffled, if these are few.
    """
    jobs = broadcast_if_few(spikes.select(*JOB_KEY).distinct(), cfg)
    version = F.col("change.newest")
    found = job_causes(tasks.join(jobs, JOB_KEY, "left_semi"), clusters, clock).select(
        *JOB_KEY,
        F.when(
            F.col("change").isNotNull(),
            F.format_string(
                CONFIG_CAUSE,
                version["cluster_name"],
                F.date_format(version["change_time"], "yyyy-MM-dd HH:mm:ss"),
                version["worker_node_type"],
                version["min_workers"].cast("string"),
                version["max_workers"].cast("string"),
            ),
        ).alias("config_cause"),
        F.when(F.col("interactive"), COMPUTE_CAUSE).alias("compute_cause"),
    )
    volume = grown_volume(usage.join(jobs, JOB_KEY, "left_semi"), clock, cfg).select(
        *JOB_KEY,
        F.format_string(
            VOLUME_CAUSE,
            whole_number(F.col("growth_pct")),
            whole_number(F.col("last_week_dbus")),
            whole_number(F.col("this_week_dbus")),
        ).alias("volume_cause"),
    )
    causes = F.array_compact(F.array("config_cause", "volume_cause", "compute_cause"))
    explained = (
        spikes.join(found, JOB_KEY, "left")
        .join(volume, JOB_KEY, "left")
        .withColumn("target_name", text_or(F.col("job_name"), F.concat(F.lit("job_"), F.col("job_id"))))
        .withColumn("root_causes", F.when(F.size(causes) > 0, causes).otherwise(F.array(F.lit(NO_CAUSE))))
    )
    return explained.select(
        *SPIKE_KEY,
        "target_name",
        "daily_cost_usd",
        "cost_growth_pct",
        "root_causes",
        F.format_string(
            EXPLANATION,
            "target_name",
            whole_number(F.col("cost_growth_pct") * 100),
            whole_number(F.col("daily_cost_usd")),
            F.concat_ws("; ", "root_causes"),
        ).alias("explanation"),
    )


def cost_spike_actions(explained: DataFrame, clock: Clock) -> DataFrame:
    details = F.to_json(
        F.struct(
            steady_round(F.col("cost_growth_pct") * 100, 1).alias("cost_growth_pct"),
            steady_round(F.col("daily_cost_usd"), 2).alias("daily_cost_usd"),
            "root_causes",
        )
    )
    return action_rows(
        explained,
        clock,
        skill="cost_spike_alert",
        kind="alert",
        workspace=F.col("workspace_id"),
        target=F.col("job_id"),
        name=F.col("target_name"),
        description=F.col("explanation"),
        # The excess of one day over a month.
        savings=F.col("daily_cost_usd") * F.col("cost_growth_pct") * 30,
        details=details,
        identity=(F.col("usage_date"),),
    )
