"""Every query by name, over a folder of driver tables.

Doubles that an operator leaves unrounded are rounded here, so that two engines that
add in a different order give equal values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.functions.numeric import steady_round
from meterwise.operators import (
    budget,
    features as feat,
    knowledge,
    memory,
    questions,
    reconciliation as recon,
    reports,
    sizing,
    spikes,
    validation,
    versions,
    waste,
)
from meterwise.plans import incremental, refresh, vector_index
from meterwise.plans.features import Features, SettledFeatures
from meterwise.plans.findings import Findings
from meterwise.session import scratch_path
from meterwise.sinks.tables import batched_rows, create_all
from meterwise.sources.driver_tables import (
    CLOCK,
    CONFIG,
    job_run_timeline,
    knowledge_docs,
    load,
    node_timeline,
)
from meterwise.streaming import documents as document_stream
from meterwise.streaming import runs as run_stream
from meterwise.streaming import utilization as utilization_stream
from meterwise.streaming.common import file_stream


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({name: steady_round(F.col(name), n) for name, n in places.items()})


class Inputs:
    """The tables of one folder and what is derived from them, planned on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self.t = load(spark, directory)

    @cached_property
    def f(self) -> Features:
        return Features(self.t, CLOCK, CONFIG)

    @cached_property
    def settled(self) -> SettledFeatures:
        return SettledFeatures(self.t, CLOCK, CONFIG)

    @cached_property
    def found(self) -> Findings:
        return Findings(self.f, self.t, CLOCK, CONFIG)

    @cached_property
    def found_in_settled(self) -> Findings:
        """For queries in which several findings read one feature."""
        return Findings(self.settled, self.t, CLOCK, CONFIG)

    @cached_property
    def timed(self) -> DataFrame:
        return feat.timed_runs(self.t.job_run_timeline, CLOCK, CONFIG.health_lookback_days)

    def stream(self, table: str) -> DataFrame:
        return file_stream(self.spark, f"{self.directory}/{table}.parquet*")


TREND_PLACES = {"daily_cost_usd": 4, "rolling_14d_avg": 4, "cost_growth_pct": 4}
HOURLY_PLACES = {"avg_cpu_pct": 4, "peak_cpu_pct": 4, "avg_mem_pct": 4, "peak_mem_pct": 4}
HEALTH_PLACES = {"avg_duration_secs": 3, "stddev_duration": 3}

SIZING_DETAILS = (
    "current_min long, current_max long, recommended_min long, recommended_max long, "
    "avg_cpu_pct double, avg_mem_pct double, reduction_pct double"
)

Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        QUERIES[name] = plan
        return plan

    return register


# --- versions and prices --------------------------------------------------------------

QUERIES["latest_jobs"] = lambda i: versions.latest_jobs(i.t.jobs)
QUERIES["latest_clusters"] = lambda i: versions.latest_clusters(i.t.clusters)
QUERIES["live_clusters"] = lambda i: versions.live_clusters(i.t.clusters)
QUERIES["last_undeleted_clusters"] = lambda i: versions.last_undeleted_clusters(i.t.clusters)


@query("priced_usage")
def _priced_usage(i: Inputs) -> DataFrame:
    priced = versions.priced_usage(i.t.usage, i.t.list_prices, CONFIG)
    return rounded(priced.drop("cluster_id"), unit_price=4, cost_usd=4)


# --- features -------------------------------------------------------------------------

QUERIES["cluster_hourly_utilization"] = lambda i: rounded(i.f.hourly.drop("updated_at"), **HOURLY_PLACES)
QUERIES["job_daily_cost"] = lambda i: rounded(
    feat.job_daily_cost(i.t.usage, i.t.list_prices, i.t.jobs, CLOCK, CONFIG), daily_cost_usd=4
)
QUERIES["job_cost_trend"] = lambda i: rounded(i.f.trend.drop("updated_at"), **TREND_PLACES)
QUERIES["job_cost_trend_calendar"] = lambda i: rounded(
    feat.job_cost_trend_calendar(i.t.usage, i.t.list_prices, i.t.jobs, CLOCK, CONFIG), **TREND_PLACES
)
QUERIES["job_runs_collapsed"] = lambda i: feat.job_runs_collapsed(
    i.t.job_run_timeline, CLOCK, CONFIG.health_lookback_days
)
QUERIES["job_runs_last_state"] = lambda i: feat.job_runs_last_state(
    i.t.job_run_timeline, CLOCK, CONFIG.health_lookback_days
)
QUERIES["completed_runs"] = lambda i: feat.completed_runs(
    i.t.job_run_timeline, CLOCK, CONFIG.health_lookback_days
)
QUERIES["job_health"] = lambda i: rounded(i.f.health.drop("updated_at"), **HEALTH_PLACES)
QUERIES["underutilized_clusters"] = lambda i: validation.underutilized_clusters(i.f.hourly, CLOCK, CONFIG)
QUERIES["top_cost_spikes"] = lambda i: validation.top_cost_spikes(
    i.f.trend, CLOCK, CONFIG
)
QUERIES["unreliable_jobs"] = lambda i: validation.unreliable_jobs(i.f.health, CONFIG)
QUERIES["latest_run_anomalies"] = lambda i: validation.latest_run_anomalies(
    i.f.health, i.t.job_run_timeline, CLOCK, CONFIG
)

# --- findings -------------------------------------------------------------------------

QUERIES["cost_spikes"] = lambda i: rounded(i.found.spikes, **TREND_PLACES)
QUERIES["spike_cause_config"] = lambda i: spikes.spike_cause_config(
    i.found.spikes, i.t.job_task_run_timeline, i.t.clusters, CLOCK
)
QUERIES["spike_cause_volume"] = lambda i: rounded(
    spikes.spike_cause_volume(i.found.spikes, i.t.usage, CLOCK, CONFIG), growth_pct=4
)
QUERIES["spike_cause_compute"] = lambda i: spikes.spike_cause_compute(
    i.found.spikes, i.t.job_task_run_timeline, i.t.clusters, CLOCK
)
QUERIES["spike_explanations"] = lambda i: rounded(
    i.found.explained_spikes.withColumn("root_causes", F.concat_ws("; ", "root_causes")),
    daily_cost_usd=4,
    cost_growth_pct=4,
)
QUERIES["cost_spike_actions"] = lambda i: i.found.spike_actions.drop("details")
QUERIES["low_utilization_rows"] = lambda i: rounded(
    sizing.low_utilization_rows(i.f.hourly, CLOCK, CONFIG), avg_cpu_pct=4, avg_mem_pct=4
)
QUERIES["low_utilization_streaks"] = lambda i: sizing.low_utilization_streaks(i.f.hourly, CLOCK, CONFIG, min_hours=1)
QUERIES["overprovisioned_clusters"] = lambda i: i.found.overprovisioned
QUERIES["right_sizing"] = lambda i: rounded(i.found.right_sized, reduction_pct=4, estimated_monthly_savings=2)
QUERIES["right_sizing_p95"] = lambda i: rounded(
    sizing.right_sizing_p95(i.f.hourly, i.found.overprovisioned, CLOCK, CONFIG), p95_cpu=4, p95_mem=4
)
QUERIES["right_sizing_actions"] = lambda i: i.found.sizing_actions.drop("details")
QUERIES["right_sizing_details"] = lambda i: i.found.sizing_actions.select(
    "workspace_id", "target_id", F.inline(F.array(F.from_json("details", SIZING_DETAILS)))
)
QUERIES["jobs_on_interactive_compute"] = lambda i: waste.jobs_on_interactive_compute(
    i.t.job_task_run_timeline, i.t.clusters, i.t.jobs, CLOCK
)
QUERIES["idle_clusters"] = lambda i: waste.idle_clusters(i.f.hourly, i.t.clusters, CLOCK, CONFIG)
QUERIES["zero_task_clusters"] = lambda i: waste.zero_task_clusters(i.t.job_task_run_timeline, i.t.clusters, CLOCK)
QUERIES["waste_items"] = lambda i: i.found.waste_items
QUERIES["top_waste_actions"] = lambda i: waste.top_waste_actions(i.found.waste_items, CONFIG)
QUERIES["waste_actions"] = lambda i: i.found.waste_actions.drop("details")
QUERIES["workspace_daily_spend"] = lambda i: rounded(i.found.daily_spend, daily_cost_usd=4)
QUERIES["budget_projection"] = lambda i: i.found.projection
QUERIES["budget_projection_calendar"] = lambda i: budget.budget_projection_calendar(i.found.daily_spend, CLOCK)
QUERIES["spend_by_tag"] = lambda i: budget.spend_by_tag(i.t.usage, i.t.list_prices, CLOCK, CONFIG)
QUERIES["budget_guardrail"] = lambda i: rounded(i.found.guardrail, budget_pct=4)
QUERIES["budget_top_drivers"] = lambda i: budget.budget_top_drivers(i.found.guardrail, i.found.workspace_drivers)
QUERIES["budget_actions"] = lambda i: i.found.budget_actions.drop("details")
QUERIES["alerts"] = lambda i: i.found_in_settled.alerts.withColumn("details", F.to_json("details"))
QUERIES["all_actions"] = lambda i: i.found_in_settled.all_actions.drop("details")

# --- reports --------------------------------------------------------------------------

QUERIES["cost_monthly_summary"] = lambda i: reports.cost_monthly_summary(i.t.usage, i.t.list_prices, CLOCK, CONFIG)
QUERIES["cost_current_month_trajectory"] = lambda i: rounded(
    reports.cost_current_month_trajectory(i.t.usage, i.t.list_prices, CLOCK, CONFIG),
    cumulative_spend=2,
    rolling_7d_avg=4,
)
QUERIES["cost_top_drivers_mtd"] = lambda i: reports.cost_top_drivers_mtd(i.f.trend, CLOCK)
QUERIES["cost_savings_captured"] = lambda i: reports.cost_savings_captured(i.t.agent_action_log, CLOCK)
QUERIES["cost_by_sku"] = lambda i: reports.cost_by_sku(i.t.usage, i.t.list_prices, CLOCK, CONFIG)
QUERIES["cluster_utilization_heatmap"] = lambda i: reports.cluster_utilization_heatmap(i.f.hourly, CLOCK)
QUERIES["cluster_over_provisioned"] = lambda i: reports.cluster_over_provisioned(
    i.f.hourly, i.t.clusters, CLOCK, CONFIG
)
QUERIES["cluster_idle_summary"] = lambda i: reports.cluster_idle_summary(i.f.hourly, CLOCK, CONFIG)
QUERIES["cluster_size_distribution"] = lambda i: reports.cluster_size_distribution(i.t.clusters)
QUERIES["job_reliability_overall"] = lambda i: reports.job_reliability_overall(i.f.health)
QUERIES["job_daily_failure_trend"] = lambda i: reports.job_daily_failure_trend(i.t.job_run_timeline, CLOCK, CONFIG)
QUERIES["job_most_unreliable"] = lambda i: reports.job_most_unreliable(i.f.health, CONFIG)
QUERIES["job_sla_breaches"] = lambda i: reports.job_sla_breaches(i.f.health, CONFIG)
QUERIES["job_sla_breach_runs"] = lambda i: reports.job_sla_breach_runs(i.timed, CONFIG)
QUERIES["job_duration_anomalies"] = lambda i: reports.job_duration_anomalies(
    i.f.health, i.t.job_run_timeline, CLOCK, CONFIG
)
QUERIES["agent_activity_mtd"] = lambda i: reports.agent_activity_mtd(i.t.agent_action_log, CLOCK)
QUERIES["agent_monthly_savings_trend"] = lambda i: reports.agent_monthly_savings_trend(i.t.agent_action_log)
QUERIES["agent_recent_actions"] = lambda i: reports.agent_recent_actions(i.t.agent_action_log)
QUERIES["agent_savings_by_skill"] = lambda i: reports.agent_savings_by_skill(i.t.agent_action_log, CLOCK)
QUERIES["monthly_digest"] = lambda i: reports.monthly_digest(i.t.agent_action_log, CLOCK)
QUERIES["monthly_digest_text"] = lambda i: reports.digest_text(reports.monthly_digest(i.t.agent_action_log, CLOCK))

# --- questions ------------------------------------------------------------------------

QUERIES["month_over_month_to_date"] = lambda i: questions.month_over_month_to_date(
    i.t.usage, i.t.list_prices, CLOCK, CONFIG
)
QUERIES["cumulative_vs_budget"] = lambda i: questions.cumulative_vs_budget(
    reports.cost_current_month_trajectory(i.t.usage, i.t.list_prices, CLOCK, CONFIG), CONFIG
)
QUERIES["workspace_spend_rank"] = lambda i: questions.workspace_spend_rank(i.found.daily_spend)
QUERIES["cluster_resizes"] = lambda i: questions.cluster_resizes(i.t.clusters, CLOCK)
QUERIES["jobs_above_failure_rate"] = lambda i: questions.jobs_above_failure_rate(i.f.health)
QUERIES["job_duration_percentiles"] = lambda i: questions.job_duration_percentiles(i.timed)
QUERIES["budget_exhaustion_date"] = lambda i: questions.budget_exhaustion_date(
    i.found.projection, i.found.budgets, CLOCK, CONFIG
)
QUERIES["budget_risk_rank"] = lambda i: questions.budget_risk_rank(i.found.budget_use)
QUERIES["total_waste"] = lambda i: questions.total_waste(i.found.waste_items)
QUERIES["cluster_job_profile"] = lambda i: questions.cluster_job_profile(
    i.f.hourly, i.t.job_task_run_timeline, i.t.jobs, CLOCK
)
QUERIES["unreliable_and_expensive"] = lambda i: questions.unreliable_and_expensive(
    i.f.trend, i.f.health, CLOCK, CONFIG
)
QUERIES["workspace_comparison"] = lambda i: questions.workspace_comparison(
    i.found.daily_spend, i.f.hourly, i.f.health, CLOCK
)
QUERIES["applied_ratio"] = lambda i: questions.applied_ratio(i.t.agent_action_log)

# --- reconciliation -------------------------------------------------------------------


def _only(check_id: str, checks: Query) -> Query:
    return lambda i: checks(i).where(F.col("check_id") == check_id)


def _utilization(i: Inputs) -> DataFrame:
    return recon.utilization_checks(i.f.hourly, CLOCK)


def _cost(i: Inputs) -> DataFrame:
    return recon.cost_checks(i.f.trend, CLOCK)


def _health(i: Inputs) -> DataFrame:
    return recon.health_checks(i.f.health, CLOCK)


def _run_totals(i: Inputs) -> DataFrame:
    return recon.run_total_checks(i.f.health, i.t.job_run_timeline, CLOCK, CONFIG)


def _actions(i: Inputs) -> DataFrame:
    return recon.action_checks(i.t.agent_action_log, CLOCK)


def _job_spot(i: Inputs) -> DataFrame:
    return recon.job_spot_check(i.settled.trend, i.f.health, i.t.job_run_timeline, CLOCK, CONFIG)


def _cluster_spot(i: Inputs) -> DataFrame:
    return recon.cluster_spot_check(i.settled.hourly, i.t.node_timeline, CLOCK)


def _cost_spot(i: Inputs) -> DataFrame:
    return recon.job_cost_spot_check(i.settled.trend, i.t.usage, i.t.list_prices, CLOCK, CONFIG)


QUERIES["recon_c1"] = lambda i: recon.hourly_row_count(i.f.hourly, i.t.node_timeline, CLOCK)
QUERIES["recon_c2"] = _only("C2", _utilization)
QUERIES["recon_c3"] = _only("C3", _utilization)
QUERIES["recon_c4"] = _only("C4", _utilization)
QUERIES["recon_c5"] = lambda i: recon.busiest_cluster_means(i.settled.hourly, i.t.node_timeline, CLOCK)
QUERIES["recon_j1"] = lambda i: recon.yesterdays_cost(i.f.trend, i.t.usage, i.t.list_prices, CLOCK, CONFIG)
QUERIES["recon_j2"] = _only("J2", _cost)
QUERIES["recon_j3"] = _only("J3", _cost)
QUERIES["recon_j4"] = _only("J4", _cost)
QUERIES["recon_j5"] = _only("J5", _cost)
QUERIES["recon_h1"] = _only("H1", _health)
QUERIES["recon_h2"] = _only("H2", _run_totals)
QUERIES["recon_h3"] = _only("H3", _run_totals)
QUERIES["recon_h4"] = _only("H4", _health)
QUERIES["recon_h5"] = _only("H5", _health)
QUERIES["recon_h6"] = _only("H6", _health)
QUERIES["recon_a1"] = _only("A1", _actions)
QUERIES["recon_a2"] = _only("A2", _actions)
QUERIES["recon_a3"] = _only("A3", _actions)
QUERIES["recon_s1"] = lambda i: recon.spot_check_row(
    _job_spot(i), "S1", recon.CRITICAL, "dearest jobs against run source"
)
QUERIES["recon_s2"] = lambda i: recon.spot_check_row(
    _cluster_spot(i), "S2", recon.HIGH, "busiest clusters against node source"
)
QUERIES["recon_s3"] = lambda i: recon.spot_check_row(
    _cost_spot(i), "S3", recon.CRITICAL, "dearest jobs against usage source"
)
QUERIES["recon_x1"] = lambda i: recon.top_driver_runs(i.f.trend, i.f.health, CLOCK)
QUERIES["recon_x2"] = lambda i: recon.over_provisioned_bounds(i.f.hourly, i.t.clusters, CLOCK, CONFIG)
QUERIES["recon_summary"] = lambda i: recon.recon_summary(recon.reconcile(i.settled, i.t, CLOCK, CONFIG))


@query("recon_damaged")
def _recon_damaged(i: Inputs) -> DataFrame:
    """Checks that must say FAIL: a cluster's hours are missing, the refresh is a day old,
    costs are half as much again, runs count double, and a report lists every cluster."""
    f, t = i.settled, i.t
    listed = f.hourly.select(*versions.CLUSTER_KEY).distinct()
    checks = [
        recon.hourly_row_count(f.hourly.where("cluster_id <> '3'"), t.node_timeline, CLOCK),
        recon.utilization_checks(f.hourly.selectExpr("* EXCEPT (updated_at)", "updated_at - INTERVAL 1 DAY AS updated_at"), CLOCK),
        recon.yesterdays_cost(
            f.trend.withColumn("daily_cost_usd", F.col("daily_cost_usd") * 1.5), t.usage, t.list_prices, CLOCK, CONFIG
        ),
        recon.run_total_checks(f.health.withColumn("total_runs", F.col("total_runs") * 2), t.job_run_timeline, CLOCK, CONFIG),
        recon.over_provisioned_bounds(
            f.hourly, t.clusters, CLOCK, CONFIG, listed.withColumns({"avg_cpu_7d": F.lit(0.0), "avg_mem_7d": F.lit(0.0)})
        ),
    ]
    return reduce(DataFrame.unionByName, checks).where(F.col("check_id").isin("C1", "C3", "J1", "H2", "X2"))


QUERIES["job_spot_check"] = _job_spot
QUERIES["cluster_spot_check"] = _cluster_spot
QUERIES["job_cost_spot_check"] = _cost_spot
QUERIES["long_running_jobs"] = lambda i: recon.long_running_jobs(i.f.health, over_secs=3600)

# --- logs and documents ---------------------------------------------------------------

QUERIES["assign_turns"] = lambda i: memory.assign_turns(i.t.agent_conversation, i.t.new_turns)
QUERIES["append_turns"] = lambda i: memory.conversation_rows(
    memory.assign_turns(i.t.agent_conversation, i.t.new_turns), CLOCK
)
QUERIES["recent_turns"] = lambda i: memory.recent_turns(i.t.agent_conversation, limit=4)
QUERIES["recent_actions_filtered"] = lambda i: memory.recent_actions_filtered(
    i.t.agent_action_log, skill_name="budget_forecast"
)
QUERIES["upsert_documents"] = lambda i: knowledge.upsert_documents(i.t.knowledge_docs, i.t.new_documents)
QUERIES["changed_documents"] = lambda i: knowledge.changed_documents(
    knowledge.upsert_documents(i.t.knowledge_docs, i.t.new_documents), knowledge.index_state(i.t.knowledge_docs)
).drop("updated_at")
QUERIES["documents_by_tag"] = lambda i: knowledge.documents_by_tag(i.t.knowledge_docs, source="src1", tag="en")
QUERIES["label_centroids"] = lambda i: knowledge.label_centroids(i.t.document_vectors).select(
    "query_id", F.posexplode("vector").alias("position", "x")
).withColumn("x", steady_round(F.col("x"), 6))
QUERIES["semantic_topk"] = lambda i: rounded(
    knowledge.semantic_topk(i.t.document_vectors, knowledge.label_centroids(i.t.document_vectors), CONFIG), score=6
)
QUERIES["semantic_search"] = lambda i: rounded(
    knowledge.semantic_search(
        i.t.knowledge_docs,
        i.t.document_vectors,
        knowledge.label_centroids(i.t.document_vectors),
        CONFIG,
    ),
    score=6,
)

# --- written and read back ------------------------------------------------------------


def _new_database(i: Inputs) -> str:
    """A database of its own in the shared folder."""
    name = f"meterwise_{uuid.uuid4().hex}"
    i.spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(i.spark, name)}'")
    return name


@query("stored_trend")
def _stored_trend(i: Inputs) -> DataFrame:
    stored = refresh.refresh_features(i.t, _new_database(i), CLOCK, CONFIG)
    return rounded(stored.trend, **TREND_PLACES)


DAYS_BEFORE = Clock(CLOCK.as_of - timedelta(days=3))


@query("days_of_utilization")
def _days_of_utilization(i: Inputs) -> DataFrame:
    """Refreshed three days ago and now: the days between are added, those out of the window dropped."""
    database = _new_database(i)
    for clock in (DAYS_BEFORE, CLOCK):
        incremental.refresh_hours(i.t, database, clock, CONFIG)
    return rounded(incremental.DayFeatures(i.t, database).hourly.drop("updated_at"), **HOURLY_PLACES)


@query("days_of_trend")
def _days_of_trend(i: Inputs) -> DataFrame:
    """As ``days_of_utilization``; rows whose frames have changed are replaced too."""
    database = _new_database(i)
    for clock in (DAYS_BEFORE, CLOCK):
        incremental.refresh_costs(i.t, database, clock, CONFIG)
    return rounded(incremental.DayFeatures(i.t, database).trend.drop("updated_at"), **TREND_PLACES)


@query("stored_findings")
def _stored_findings(i: Inputs) -> DataFrame:
    """Logged twice; the second time replaces the first."""
    database = _new_database(i)
    create_all(i.spark, database)
    for _ in range(2):
        refresh.log_findings(i.settled, i.t, database, CLOCK, CONFIG)
    return batched_rows(i.spark, f"{database}.agent_action_log").drop("details")


@query("stored_checks")
def _stored_checks(i: Inputs) -> DataFrame:
    """The log of a fast run of the checks."""
    database = _new_database(i)
    create_all(i.spark, database)
    refresh.log_reconciliation(i.settled, i.t, database, CLOCK, CONFIG)
    return i.spark.table(f"{database}.reconciliation_log").drop("detail")


@query("stored_actions")
def _stored_actions(i: Inputs) -> DataFrame:
    database = _new_database(i)
    create_all(i.spark, database)
    for _ in range(2):
        refresh.record_actions(i.t.agent_action_log.drop("action_id", "action_timestamp"), database, CLOCK, "by-hand-1")
    return batched_rows(i.spark, f"{database}.agent_action_log")


@query("stored_turns")
def _stored_turns(i: Inputs) -> DataFrame:
    """Two batches; the second is numbered on from the first, and comes twice."""
    database = _new_database(i)
    create_all(i.spark, database)
    for batch in ("turns-1", "turns-2", "turns-2"):
        refresh.record_turns(i.t.new_turns, database, CLOCK, batch)
    return batched_rows(i.spark, f"{database}.agent_conversation").select("session_id", "turn", "role", "content")


@query("stored_documents")
def _stored_documents(i: Inputs) -> DataFrame:
    database = _new_database(i)
    create_all(i.spark, database)
    refresh.upsert_corpus(i.t.knowledge_docs, database)
    refresh.upsert_corpus(i.t.new_documents, database)
    return i.spark.table(f"{database}.knowledge_docs")


@query("stored_search")
def _stored_search(i: Inputs) -> DataFrame:
    """The search over the corpus as the batches left it."""
    found = knowledge.semantic_search(
        _stored_documents(i), i.t.document_vectors, knowledge.label_centroids(i.t.document_vectors), CONFIG
    )
    return rounded(found, score=6)


@query("stored_index_search")
def _stored_index_search(i: Inputs) -> DataFrame:
    """All vectors in an index; those of one label move to other lists and back before the search."""
    name, vectors = f"{_new_database(i)}.vector_index", i.t.document_vectors
    vector_index.build_index(vectors, name)
    changed = vectors.where("label = 1")
    vector_index.refresh_index(changed.withColumn("vector", F.expr("transform(vector, x -> -x)")), name)
    vector_index.refresh_index(changed, name)
    return rounded(vector_index.search_index(i.spark, name, knowledge.label_centroids(vectors), CONFIG), score=6)


@query("stored_report")
def _stored_report(i: Inputs) -> DataFrame:
    database = _new_database(i)
    refresh.publish_reports(i.f, i.t, database, CLOCK, CONFIG, ["cost_by_sku"])
    return i.spark.table(f"{database}.cost_by_sku")


# --- streams --------------------------------------------------------------------------


@query("stream_hourly_utilization")
def _stream_hourly(i: Inputs) -> DataFrame:
    path, checkpoint = scratch_path(i.spark, "node-hours"), scratch_path(i.spark, "node-hours-progress")
    utilization_stream.refresh(node_timeline(i.stream("events")), path, checkpoint)
    return rounded(utilization_stream.hourly_from(i.spark, path), **HOURLY_PLACES)


@query("stream_runs_collapsed")
def _stream_runs(i: Inputs) -> DataFrame:
    path, checkpoint = scratch_path(i.spark, "runs"), scratch_path(i.spark, "runs-progress")
    run_stream.refresh(job_run_timeline(i.stream("orders")), path, checkpoint)
    return run_stream.collapsed_from(i.spark, path)


@query("stream_changed_documents")
def _stream_documents(i: Inputs) -> DataFrame:
    feed, state = scratch_path(i.spark, "feed"), scratch_path(i.spark, "index-state")
    document_stream.refresh(
        knowledge_docs(i.stream("documents")), feed, state, scratch_path(i.spark, "feed-progress")
    )
    return document_stream.feed_from(i.spark, feed).drop("batch_id", "updated_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plan(Inputs(spark, directory))

        return run

    return {name: bind(plan) for name, plan in QUERIES.items()}
