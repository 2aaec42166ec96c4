"""Checks of the features against their sources, as rows.

Checks that read the same table share one aggregation. Each gives a row
(check_id, severity, status, measured, tolerance, summary); a null measure fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.joins import join_null_safe
from meterwise.functions.numeric import count_where, steady_round
from meterwise.operators.features import timed_runs
from meterwise.operators.reports import cluster_over_provisioned, cost_top_drivers_mtd
from meterwise.operators.versions import CLUSTER_KEY, JOB_KEY, priced_usage
from meterwise.session import settle

# Severities, statuses and tolerances.
CRITICAL, HIGH, MEDIUM = "critical", "high", "medium"
KNOWN_STATUSES = ["proposed", "approved", "applied", "rejected"]
ROW_COUNT_TOLERANCE = 0.02
MEANS_TOLERANCE_POINTS = 2
USD_TOLERANCE = 0.005
TOTAL_RUNS_TOLERANCE = 0.001
FAILED_RUNS_TOLERANCE = 1
FRESH_MINUTES = 60
FRESH_DAYS = 2
EXTREME_GROWTH = 10
LONG_RUN_SECS = 86_400
SPOT_ENTITIES = 5
SPOT_RUNS = 0.02
SPOT_FAILED = 0.05
SPOT_SECS = 30
SPOT_CPU_POINTS = 3
SPOT_NODES = 1
SPOT_USD = 0.01


@dataclass(frozen=True)
class Check:
    check_id: str
    severity: str
    measured: Column
    tolerance: float
    passes: str
    """``below``: measured < tolerance; ``within``: <=; ``above``: >."""
    summary: str

    def row(self) -> Column:
        measured, limit = self.measured.cast("double"), F.lit(float(self.tolerance))
        holds = {"below": measured < limit, "within": measured <= limit, "above": measured > limit}[self.passes]
        return F.struct(
            F.lit(self.check_id).alias("check_id"),
            F.lit(self.severity).alias("severity"),
            F.when(holds, "PASS").otherwise("FAIL").alias("status"),
            steady_round(measured, 6).alias("measured"),
            limit.alias("tolerance"),
            F.lit(self.summary).alias("summary"),
        )


def check_rows(one_row: DataFrame, *checks: Check) -> DataFrame:
    return one_row.select(F.inline(F.array(*[c.row() for c in checks])))


def _outside(column: str, low: float, high: float) -> Column:
    return count_where(~F.col(column).between(low, high))


def _sum_of(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def _relative(source: str, feature: str) -> Column:
    src, fea = F.coalesce(source, F.lit(0)), F.coalesce(feature, F.lit(0))
    return F.abs(src - fea) / F.greatest(src, F.lit(1))


def _side_by_side(source: DataFrame, feature: DataFrame) -> DataFrame:
    """One row with the columns of two one-row frames of different column names."""
    both = source.unionByName(feature, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- hourly utilisation -------------------------------------------------------------


def utilization_checks(hourly: DataFrame, clock: Clock) -> DataFrame:
    """C2 bounds, C3 freshness, C4 keys. ``hourly`` carries ``updated_at``."""
    week = clock.times_since("hour_window", clock.midnight_ago(7))
    percents = ["avg_cpu_pct", "peak_cpu_pct", "avg_mem_pct", "peak_mem_pct"]
    bad = [count_where(week & ~F.col(p).between(0, 100)) for p in percents]
    bad.append(count_where(week & (F.col("node_count") < 0)))
    bad.append(count_where(week & (F.col("node_type_count") > F.col("node_count"))))
    nulls = [count_where(F.col(c).isNull()) for c in [*CLUSTER_KEY, "hour_window"]]
    measured = hourly.agg(
        _sum_of(bad).alias("bad"),
        F.timestamp_diff("MINUTE", F.max("updated_at"), clock.now).alias("age"),
        _sum_of(nulls).alias("nulls"),
    )
    return check_rows(
        measured,
        Check("C2", HIGH, F.col("bad"), 0, "within", "utilisation within bounds"),
        Check("C3", MEDIUM, F.col("age"), FRESH_MINUTES, "below", "minutes since utilisation refresh"),
        Check("C4", HIGH, F.col("nulls"), 0, "within", "no null utilisation keys"),
    )


def hourly_row_count(hourly: DataFrame, nodes: DataFrame, clock: Clock) -> DataFrame:
    """C1: cluster hours of the last day, source against feature."""
    since = clock.midnight_ago(1)
    source = (
        nodes.where(clock.times_since("start_time", since))
        .select(*CLUSTER_KEY, F.date_trunc("hour", "start_time"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("src"))
    )
    feature = hourly.where(clock.times_since("hour_window", since)).agg(F.count(F.lit(1)).alias("fea"))
    return check_rows(
        _side_by_side(source, feature),
        Check("C1", HIGH, _relative("src", "fea"), ROW_COUNT_TOLERANCE, "below", "hourly row count against source"),
    )


def _busiest(hourly: DataFrame, clock: Clock, limit: int, cluster_id: str | None = None) -> DataFrame:
    """The clusters with most node hours of the last day; at most ``limit`` rows."""
    recent = hourly.where(clock.times_since("hour_window", clock.midnight_ago(1)))
    if cluster_id is not None:
        recent, limit = recent.where(F.col("cluster_id") == cluster_id), 1
    per_cluster = recent.groupBy(*CLUSTER_KEY).agg(
        F.sum("node_count").alias("node_hours"),
        F.max("hour_window").alias("latest_hour"),
        F.avg("avg_cpu_pct").alias("fea_cpu"),
        F.avg("avg_mem_pct").alias("fea_mem"),
    )
    return per_cluster.orderBy(F.desc("node_hours"), *CLUSTER_KEY).limit(limit)


def busiest_cluster_means(hourly: DataFrame, nodes: DataFrame, clock: Clock) -> DataFrame:
    """C5: means of the busiest cluster over the last day, in points."""
    top = _busiest(hourly, clock, 1)
    source = (
        nodes.where(clock.times_since("start_time", clock.midnight_ago(1)))
        .join(F.broadcast(top.select(*CLUSTER_KEY)), CLUSTER_KEY, "left_semi")  # one row
        .groupBy(*CLUSTER_KEY)
        .agg(F.avg("cpu_user_percent").alias("src_cpu"), F.avg("mem_used_percent").alias("src_mem"))
    )
    apart = F.greatest(F.abs(F.col("src_cpu") - F.col("fea_cpu")), F.abs(F.col("src_mem") - F.col("fea_mem")))
    measured = top.join(source, CLUSTER_KEY).agg(F.max(apart).alias("points"))
    return check_rows(
        measured,
        Check("C5", HIGH, F.col("points"), MEANS_TOLERANCE_POINTS, "below", "busiest cluster means against source"),
    )


# --- job cost -----------------------------------------------------------------------


def cost_checks(trend: DataFrame, clock: Clock) -> DataFrame:
    """J2 uniqueness, J3 bounds, J4 freshness, J5 growth."""
    extreme = (
        clock.dates_since("usage_date", clock.date_ago(30))
        & (F.col("rolling_14d_avg") > 0)
        & (F.abs("cost_growth_pct") > EXTREME_GROWTH)
    )
    per_key = trend.groupBy(*JOB_KEY, "usage_date").agg(
        F.count(F.lit(1)).alias("n"),
        (count_where(F.col("daily_cost_usd") < 0) + count_where(F.col("rolling_14d_avg") < 0)).alias("negative"),
        count_where(extreme).alias("extreme"),
    )
    measured = per_key.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("worst"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        F.datediff(clock.today, F.max("usage_date")).alias("age"),
        F.coalesce(F.sum("extreme"), F.lit(0)).alias("extreme"),
    )
    return check_rows(
        measured,
        Check("J2", CRITICAL, F.col("worst"), 1, "within", "one row per job and day"),
        Check("J3", HIGH, F.col("negative"), 0, "within", "no negative cost"),
        Check("J4", MEDIUM, F.col("age"), FRESH_DAYS, "within", "days since last cost"),
        Check("J5", HIGH, F.col("extreme"), 0, "within", "rows with extreme growth"),
    )


def yesterdays_cost(trend: DataFrame, usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """J1: yesterday's cost, source against feature."""
    yesterday = F.col("usage_date") == clock.date_ago(1)
    source = priced_usage(usage.where(F.col("job_id").isNotNull() & yesterday), prices, cfg).agg(
        F.sum("cost_usd").alias("src")
    )
    feature = trend.where(yesterday).agg(F.sum("daily_cost_usd").alias("fea"))
    return check_rows(
        _side_by_side(source, feature),
        Check("J1", CRITICAL, _relative("src", "fea"), USD_TOLERANCE, "below", "yesterday's cost against source"),
    )


# --- job health ---------------------------------------------------------------------


def health_checks(health: DataFrame, clock: Clock) -> DataFrame:
    """H1 uniqueness, H4 bounds, H5 plausibility, H6 freshness."""
    bad = [
        _outside("failure_rate", 0, 1),
        count_where(F.col("failed_runs") > F.col("total_runs")),
        count_where(F.col("avg_duration_secs") < 0),
        count_where(F.col("max_duration_secs") < F.col("avg_duration_secs")),
        count_where(F.col("stddev_duration") < 0),
    ]
    per_key = health.groupBy(*JOB_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        _sum_of(bad).alias("bad"),
        count_where(F.col("avg_duration_secs") > LONG_RUN_SECS).alias("long"),
        F.max("updated_at").alias("updated_at"),
    )
    measured = per_key.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("worst"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.sum("long"), F.lit(0)).alias("long"),
        F.timestamp_diff("MINUTE", F.max("updated_at"), clock.now).alias("age"),
    )
    return check_rows(
        measured,
        Check("H1", HIGH, F.col("worst"), 1, "within", "one row per job"),
        Check("H4", HIGH, F.col("bad"), 0, "within", "health within bounds"),
        Check("H5", HIGH, F.col("long"), 0, "within", "jobs with mean duration above a day"),
        Check("H6", MEDIUM, F.col("age"), FRESH_MINUTES, "below", "minutes since health refresh"),
    )


def run_total_checks(health: DataFrame, runs: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    """H2 all runs, H3 failed runs: source against feature."""
    source = timed_runs(runs, clock, cfg.health_lookback_days).agg(
        F.count(F.lit(1)).alias("src_runs"), count_where(F.col("failed")).alias("src_failed")
    )
    feature = health.agg(F.sum("total_runs").alias("fea_runs"), F.sum("failed_runs").alias("fea_failed"))
    failed = F.abs(F.coalesce("src_failed", F.lit(0)) - F.coalesce("fea_failed", F.lit(0)))
    return check_rows(
        _side_by_side(source, feature),
        Check("H2", CRITICAL, _relative("src_runs", "fea_runs"), TOTAL_RUNS_TOLERANCE, "below",
              "total runs against source"),
        Check("H3", CRITICAL, failed, FAILED_RUNS_TOLERANCE, "within", "failed runs against source"),
    )


def long_running_jobs(health: DataFrame, limit: int = 20, over_secs: int = LONG_RUN_SECS) -> DataFrame:
    """The jobs behind H5, or those whose mean duration is above another bound."""
    slow = health.where(F.col("avg_duration_secs") > over_secs)
    return slow.orderBy(F.desc("avg_duration_secs"), *JOB_KEY).limit(limit).select(
        *JOB_KEY, "job_name", steady_round(F.col("avg_duration_secs") / 3600, 1).alias("avg_hours")
    )


# --- action log ---------------------------------------------------------------------


def action_checks(log: DataFrame, clock: Clock) -> DataFrame:
    """A1 statuses, A2 bounds, A3 JSON."""
    status = F.col("status")
    unreadable = F.col("details").isNotNull() & F.try_parse_json("details").isNull()
    measured = log.agg(
        count_where(status.isNull() | ~status.isin(KNOWN_STATUSES)).alias("unknown"),
        _sum_of(
            [
                count_where(F.col("projected_savings") < 0),
                count_where(F.col("action_timestamp") > clock.now),
                count_where(F.col("action_id").isNull() | F.col("target_id").isNull()),
            ]
        ).alias("bad"),
        count_where(unreadable).alias("unreadable"),
    )
    return check_rows(
        measured,
        Check("A1", HIGH, F.col("unknown"), 0, "within", "rows with an unknown status"),
        Check("A2", HIGH, F.col("bad"), 0, "within", "actions within bounds"),
        Check("A3", MEDIUM, F.col("unreadable"), 0, "within", "rows whose details are not JSON"),
    )


# --- spot checks --------------------------------------------------------------------


def _dearest_jobs(trend: DataFrame, clock: Clock, job_id: str | None) -> DataFrame:
    """The jobs with most spend this month; at most five rows."""
    month = trend.where(clock.dates_since("usage_date", clock.month_start))
    limit = SPOT_ENTITIES
    if job_id is not None:
        month, limit = month.where(F.col("job_id") == job_id), 1
    per_job = month.groupBy(*JOB_KEY).agg(
        F.max("job_name").alias("job_name"), steady_round(F.sum("daily_cost_usd"), 6).alias("spend")
    )
    return per_job.orderBy(F.desc("spend"), *JOB_KEY).limit(limit).select(*JOB_KEY, "job_name")


def _or_zero(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in columns]


def job_spot_check(
    trend: DataFrame, health: DataFrame, runs: DataFrame, clock: Clock, cfg: Config, job_id: str | None = None
) -> DataFrame:
    """The five dearest jobs: runs, failures and mean duration, feature against source."""
    top = _dearest_jobs(trend, clock, job_id)
    of_top = runs.join(F.broadcast(top.select(*JOB_KEY)), JOB_KEY, "left_semi")  # five rows
    source = (
        timed_runs(of_top, clock, cfg.health_lookback_days)
        .groupBy(*JOB_KEY)
        .agg(
            F.count(F.lit(1)).alias("src_runs"),
            count_where(F.col("failed")).alias("src_failed"),
            steady_round(F.avg("duration_secs"), 0).cast("long").alias("src_avg_secs"),
        )
    )
    feature = health.select(
        *JOB_KEY,
        F.col("total_runs").alias("fea_runs"),
        F.col("failed_runs").alias("fea_failed"),
        steady_round(F.col("avg_duration_secs"), 0).cast("long").alias("fea_avg_secs"),
    )
    compared = top.join(source, JOB_KEY, "left").join(feature, JOB_KEY, "left").select(
        *JOB_KEY,
        "job_name",
        *_or_zero("src_runs", "fea_runs", "src_failed", "fea_failed", "src_avg_secs", "fea_avg_secs"),
    )
    agrees = (
        (_relative("src_runs", "fea_runs") < SPOT_RUNS)
        & (
            F.abs(F.col("src_failed") - F.col("fea_failed"))
            <= F.greatest(F.lit(1.0), F.col("src_failed") * SPOT_FAILED)
        )
        & (F.abs(F.col("src_avg_secs") - F.col("fea_avg_secs")) < SPOT_SECS)
    )
    return compared.withColumn("agrees", agrees)


def cluster_spot_check(
    hourly: DataFrame, nodes: DataFrame, clock: Clock, cluster_id: str | None = None
) -> DataFrame:
    """The five clusters with most node hours of the last day: nodes and CPU of their
    latest hour, feature against source."""
    top = _busiest(hourly, clock, SPOT_ENTITIES, cluster_id).select(*CLUSTER_KEY, "latest_hour")
    hour = F.date_trunc("hour", "start_time")
    recent = nodes.where(clock.times_since("start_time", clock.midnight_ago(1)))
    source = (
        recent.withColumn("latest_hour", hour)
        .join(F.broadcast(top), [*CLUSTER_KEY, "latest_hour"], "left_semi")  # five rows
        .groupBy(*CLUSTER_KEY)
        .agg(
            F.count_distinct("instance_id").alias("src_nodes"),
            steady_round(F.avg("cpu_user_percent"), 1).alias("src_avg_cpu"),
        )
    )
    feature = hourly.select(
        *CLUSTER_KEY,
        F.col("hour_window").alias("latest_hour"),
        F.col("node_count").alias("fea_nodes"),
        steady_round(F.col("avg_cpu_pct"), 1).alias("fea_avg_cpu"),
    )
    compared = top.join(source, CLUSTER_KEY, "left").join(feature, [*CLUSTER_KEY, "latest_hour"], "left").select(
        *CLUSTER_KEY, "latest_hour", *_or_zero("src_nodes", "fea_nodes", "src_avg_cpu", "fea_avg_cpu")
    )
    agrees = (F.abs(F.col("src_nodes") - F.col("fea_nodes")) <= SPOT_NODES) & (
        F.abs(F.col("src_avg_cpu") - F.col("fea_avg_cpu")) < SPOT_CPU_POINTS
    )
    return compared.withColumn("agrees", agrees)


def job_cost_spot_check(
    trend: DataFrame, usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config, job_id: str | None = None
) -> DataFrame:
    """The five dearest jobs: yesterday's cost, feature against source."""
    top = _dearest_jobs(trend, clock, job_id)
    yesterday = F.col("usage_date") == clock.date_ago(1)
    of_top = usage.where(yesterday).join(F.broadcast(top.select(*JOB_KEY)), JOB_KEY, "left_semi")  # five rows
    source = priced_usage(of_top, prices, cfg).groupBy(*JOB_KEY).agg(
        steady_round(F.sum("cost_usd"), 2).alias("src_usd")
    )
    feature = trend.where(yesterday).select(*JOB_KEY, steady_round(F.col("daily_cost_usd"), 2).alias("fea_usd"))
    compared = top.join(source, JOB_KEY, "left").join(feature, JOB_KEY, "left").select(
        *JOB_KEY, "job_name", *_or_zero("src_usd", "fea_usd")
    )
    return compared.withColumn("agrees", _relative("src_usd", "fea_usd") < SPOT_USD)


def spot_check_row(compared: DataFrame, check_id: str, severity: str, summary: str) -> DataFrame:
    measured = compared.agg(count_where(~F.col("agrees")).alias("apart"))
    return check_rows(measured, Check(check_id, severity, F.col("apart"), 0, "within", summary))


# --- across tables ------------------------------------------------------------------


def top_driver_runs(trend: DataFrame, health: DataFrame, clock: Clock) -> DataFrame:
    """X1: the dearest job has runs."""
    dearest = cost_top_drivers_mtd(trend, clock, 1).select("job_name", "workspace_id")
    measured = (
        health.join(F.broadcast(dearest), ["job_name", "workspace_id"], "left_semi")  # one row
        .agg(F.coalesce(F.sum("total_runs"), F.lit(0)).alias("runs"))
    )
    return check_rows(measured, Check("X1", HIGH, F.col("runs"), 0, "above", "runs of the dearest job"))


def over_provisioned_bounds(
    hourly: DataFrame, clusters: DataFrame, clock: Clock, cfg: Config, listed: DataFrame | None = None
) -> DataFrame:
    """X2: no listed cluster lies above a threshold, by its listed means or by those
    computed anew from its hours of the week; one without hours fails too. ``listed`` is
    the report as published; by default it is taken from the operator."""
    if listed is None:
        listed = cluster_over_provisioned(hourly, clusters, clock, cfg)
    listed = listed.select(*CLUSTER_KEY, "avg_cpu_7d", "avg_mem_7d")
    week = hourly.where(clock.times_since("hour_window", clock.midnight_ago(7)))
    cpu, mem = F.col("avg_cpu_pct"), F.col("avg_mem_pct")
    means = week.groupBy(*CLUSTER_KEY).agg(
        (F.sum(cpu) / F.count(cpu)).alias("cpu"), (F.sum(mem) / F.count(mem)).alias("mem")
    )
    above = [
        F.col(name) > limit
        for names, limit in ((("avg_cpu_7d", "cpu"), cfg.low_cpu_pct), (("avg_mem_7d", "mem"), cfg.low_mem_pct))
        for name in names
    ]
    wrong = reduce(Column.__or__, above, F.col("cpu").isNull())
    measured = join_null_safe(listed, means, CLUSTER_KEY, "left").agg(count_where(wrong).alias("above"))
    return check_rows(
        measured, Check("X2", MEDIUM, F.col("above"), 0, "within", "over-provisioned clusters above a threshold")
    )


# --- all of them --------------------------------------------------------------------


def checked_windows(
    nodes: DataFrame, usage: DataFrame, runs: DataFrame, clock: Clock, cfg: Config
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows and columns of each source that some check reads, written once: each source
    is scanned once for all checks."""
    recent = nodes.where(clock.times_since("start_time", clock.midnight_ago(1))).select(
        *CLUSTER_KEY, "start_time", "instance_id", "cpu_user_percent", "mem_used_percent"
    )
    yesterday = usage.where(F.col("job_id").isNotNull() & (F.col("usage_date") == clock.date_ago(1)))
    lookback = runs.where(clock.times_since("period_start_time", clock.midnight_ago(cfg.health_lookback_days)))
    return settle(recent, "checked-nodes"), settle(yesterday, "checked-usage"), settle(lookback, "checked-runs")


def reconcile(
    features,
    tables,
    clock: Clock,
    cfg: Config,
    mode: str = "full",
    job_id: str | None = None,
    cluster_id: str | None = None,
) -> DataFrame:
    """All checks of a mode. ``features`` has ``hourly``, ``trend`` and ``health``, best
    read from where they were written. ``fast`` leaves out what scans the sources;
    naming a job or a cluster runs the spot checks in either mode."""
    if mode not in ("fast", "full"):
        raise ValueError(f"mode must be fast or full, not {mode!r}")
    nodes, usage, runs = tables.node_timeline, tables.usage, tables.job_run_timeline
    if mode == "full":
        nodes, usage, runs = checked_windows(nodes, usage, runs, clock, cfg)
    checks = [
        utilization_checks(features.hourly, clock),
        cost_checks(features.trend, clock),
        health_checks(features.health, clock),
        action_checks(tables.agent_action_log, clock),
    ]
    if mode == "full":
        checks += [
            hourly_row_count(features.hourly, nodes, clock),
            busiest_cluster_means(features.hourly, nodes, clock),
            yesterdays_cost(features.trend, usage, tables.list_prices, clock, cfg),
            run_total_checks(features.health, runs, clock, cfg),
            top_driver_runs(features.trend, features.health, clock),
            over_provisioned_bounds(features.hourly, tables.clusters, clock, cfg),
        ]
    if mode == "full" or job_id is not None or cluster_id is not None:
        checks += [
            spot_check_row(
                job_spot_check(features.trend, features.health, runs, clock, cfg, job_id),
                "S1", CRITICAL, "dearest jobs against run source",
            ),
            spot_check_row(
                cluster_spot_check(features.hourly, nodes, clock, cluster_id),
                "S2", HIGH, "busiest clusters against node source",
            ),
            spot_check_row(
                job_cost_spot_check(features.trend, usage, tables.list_prices, clock, cfg, job_id),
                "S3", CRITICAL, "dearest jobs against usage source",
            ),
        ]
    rows = reduce(DataFrame.unionByName, checks)
    # H5 and J5 belong to the daily group although they share a cheap aggregation.
    return rows if mode == "full" else rows.where(~F.col("check_id").isin("H5", "J5"))


def recon_summary(checks: DataFrame) -> DataFrame:
    failed = F.col("status") == "FAIL"
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("status") == "PASS").alias("passed"),
        count_where(failed).alias("failed"),
        count_where(failed & (F.col("severity") == CRITICAL)).alias("critical_failed"),
    )


def raise_on_critical(summary: DataFrame) -> None:
    """For a job that must stop when a critical check fails."""
    count = summary.first()["critical_failed"]
    if count:
        raise RuntimeError(f"{count} critical reconciliation check(s) failed")
