"""The scheduled work: features, fast checks, findings, views."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise import schemas
from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.operators import reports as r
from meterwise.operators.actions import log_actions, without_repeats
from meterwise.operators.knowledge import upsert_documents
from meterwise.operators.memory import assign_turns, conversation_rows
from meterwise.operators.reconciliation import reconcile
from meterwise.plans.features import Features, StoredFeatures
from meterwise.plans.findings import Findings
from meterwise.schemas import conform
from meterwise.session import settle
from meterwise.sinks.tables import append_rows, batched_rows, create_all, publish_version, replace_batch, upsert_buckets
from meterwise.sources.platform import PlatformTables


def refresh_features(tables: PlatformTables, database: str, clock: Clock, cfg: Config) -> StoredFeatures:
    """Rebuild the feature tables. Readers see the last ones until the new are complete."""
    create_all(tables.spark, database)
    fresh = Features(tables, clock, cfg)
    for rows, name in (
        (fresh.hourly, "feat_cluster_utilization"),
        (fresh.trend, "feat_job_cost_trend"),
        (fresh.health, "feat_job_health"),
    ):
        publish_version(conform(rows, schemas.TABLES[name]).hint("rebalance"), f"{database}.{name}")
    return StoredFeatures(tables.spark, database)


def log_reconciliation(
    features, tables: PlatformTables, database: str, clock: Clock, cfg: Config, mode: str = "fast"
) -> DataFrame:
    """Run the checks and append their rows to the log, with the time and mode of the run;
    gives them back as stored."""
    value = F.coalesce(F.col("measured").cast("string"), F.lit("no value"))
    detail = F.format_string("%s: %s, tolerance %s", "summary", value, F.col("tolerance").cast("string"))
    run = {"detail": detail, "mode": F.lit(mode), "checked_at": clock.now}
    checks = settle(reconcile(features, tables, clock, cfg, mode).withColumns(run), "checks")
    append_rows(checks, f"{database}.reconciliation_log", schemas.RECONCILIATION)
    return checks


def log_findings(features, tables: PlatformTables, database: str, clock: Clock, cfg: Config) -> None:
    """Make the action rows of all four findings the day's batch of the log. A repeated refresh replaces the batch."""
    found = Findings(features, tables, clock, cfg)
    rows = settle(without_repeats(found.all_actions), "findings")
    replace_batch(rows, f"{database}.agent_action_log", schemas.ACTION_LOG, f"findings-{clock.day.isoformat()}")


def record_actions(requests: DataFrame, database: str, clock: Clock, batch: str) -> None:
    """Log actions recorded by hand, under the name of their batch; the same batch again adds nothing."""
    rows = settle(log_actions(requests, clock), "actions")
    replace_batch(rows, f"{database}.agent_action_log", schemas.ACTION_LOG, batch)


def record_turns(new: DataFrame, database: str, clock: Clock, batch: str) -> None:
    """Number a batch of messages on from the log's last turns and log them under the batch's name. The same
    batch again is numbered on from the other batches, so it replaces its own rows by equal ones; only the last batch
    of a session may be repeated."""
    log = f"{database}.agent_conversation"
    rows = conversation_rows(assign_turns(batched_rows(new.sparkSession, log, but=batch), new), clock)
    replace_batch(settle(rows, "turns"), log, schemas.CONVERSATION, batch)


def upsert_corpus(batch: DataFrame, database: str) -> None:
    """Publish the corpus after the batch. Buckets without a key of the batch keep their files."""
    upsert_buckets(batch, f"{database}.knowledge_docs", schemas.KNOWLEDGE_DOCS, schemas.BUCKETED["knowledge_docs"], upsert_documents)


def report_views(features, tables: PlatformTables, clock: Clock, cfg: Config) -> dict[str, DataFrame]:
    """The report views by name, in their presentation order."""
    usage, prices, log = tables.usage, tables.list_prices, tables.agent_action_log
    hourly, trend, health, runs = features.hourly, features.trend, features.health, tables.job_run_timeline
    return {
        "cost_monthly_summary": r.cost_monthly_summary(usage, prices, clock, cfg).orderBy("month", ascending=False),
        "cost_current_month_trajectory": r.cost_current_month_trajectory(usage, prices, clock, cfg),
        "cost_top_drivers_mtd": r.cost_top_drivers_mtd(trend, clock),
        "cost_savings_captured": r.cost_savings_captured(log, clock).orderBy(
            "total_projected_savings", ascending=False
        ),
        "cost_by_sku": r.cost_by_sku(usage, prices, clock, cfg),
        "cluster_utilization_heatmap": r.cluster_utilization_heatmap(hourly, clock).orderBy(
            "cluster_id", "day", "hour_of_day"
        ),
        "cluster_over_provisioned": r.cluster_over_provisioned(hourly, tables.clusters, clock, cfg).orderBy(
            "avg_cpu_7d"
        ),
        "cluster_idle_summary": r.cluster_idle_summary(hourly, clock, cfg).orderBy("idle_node_pct", ascending=False),
        "cluster_size_distribution": r.cluster_size_distribution(tables.clusters).orderBy(
            "cluster_count", ascending=False
        ),
        "job_reliability_overall": r.job_reliability_overall(health),
        "job_daily_failure_trend": r.job_daily_failure_trend(runs, clock, cfg).orderBy("run_date"),
        "job_most_unreliable": r.job_most_unreliable(health, cfg),
        "job_sla_breaches": r.job_sla_breaches(health, cfg),
        "job_duration_anomalies": r.job_duration_anomalies(health, runs, clock, cfg),
        "agent_activity_mtd": r.agent_activity_mtd(log, clock).orderBy("total_projected_savings", ascending=False),
        "agent_monthly_savings_trend": r.agent_monthly_savings_trend(log).orderBy("month", ascending=False),
        "agent_recent_actions": r.agent_recent_actions(log),
        "agent_savings_by_skill": r.agent_savings_by_skill(log, clock).orderBy("total_savings", ascending=False),
    }


def publish_reports(
    features, tables: PlatformTables, database: str, clock: Clock, cfg: Config, names: Collection[str] | None = None
) -> list[str]:
    """Publish the reports (all, or those named) as views of the catalog over their
    written rows: they outlive the session, and no plan of today is kept for later."""
    views = report_views(features, tables, clock, cfg)
    chosen = [name for name in views if names is None or name in names]
    for name in chosen:
        publish_version(views[name], f"{database}.{name}")
    return chosen
