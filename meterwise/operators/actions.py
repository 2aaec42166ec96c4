"""The action log: how findings become rows in it, and alerts about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.functions.numeric import steady_round
from meterwise.schemas import ACTION_LOG, conform


def action_rows(
    findings: DataFrame,
    clock: Clock,
    *,
    skill: Column | str,
    kind: Column | str,
    workspace: Column,
    target: Column,
    name: Column,
    description: Column,
    savings: Column,
    details: Column,
    status: Column | str = "proposed",
    identity: tuple[Column, ...] = (),
) -> DataFrame:
    """One log row per finding.

    The id is a hash of the skill, the target and the day (plus ``identity``, which must tell
    findings about one target apart), not a random value: a retried task or a repeated run gives the same ids.
    """
    skill = F.lit(skill) if isinstance(skill, str) else skill
    kind = F.lit(kind) if isinstance(kind, str) else kind
    status = F.lit(status) if isinstance(status, str) else status
    parts = [skill, workspace, target, F.lit(clock.day.isoformat()), *[c.cast("string") for c in identity]]
    key = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    rows = findings.select(
        F.sha2(key, 256).alias("action_id"),
        clock.now.alias("action_timestamp"),
        skill.alias("skill_name"),
        kind.alias("action_type"),
        workspace.alias("workspace_id"),
        target.alias("target_id"),
        name.alias("target_name"),
        description.alias("description"),
        F.coalesce(steady_round(savings, 2), F.lit(0.0)).alias("projected_savings"),
        status.alias("status"),
        details.alias("details"),
    )
    return conform(rows, ACTION_LOG)


def log_actions(requests: DataFrame, clock: Clock) -> DataFrame:
    """Rows for a batch of actions recorded by hand. ``requests`` has the log's
    columns without id and time; savings, status and details may be null."""
    return action_rows(
        requests,
        clock,
        skill=F.col("skill_name"),
        kind=F.col("action_type"),
        workspace=F.col("workspace_id"),
        target=F.col("target_id"),
        name=F.col("target_name"),
        description=F.col("description"),
        savings=F.col("projected_savings"),
        details=F.coalesce(F.col("details"), F.lit("{}")),
        status=F.coalesce(F.col("status"), F.lit("proposed")),
        identity=(F.col("action_type"), F.col("description")),
    )


def all_actions(*logs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, logs)


def without_repeats(log: DataFrame) -> DataFrame:
    """One copy of each action, the earliest, for a log that a retried job appended to twice. Rows that share an id
    but say different things end the job: none is dropped unseen."""
    content = [c for c in log.columns if c != "action_timestamp"]
    copies = log.groupBy(*content).agg(F.min("action_timestamp").alias("action_timestamp"))
    per_id = copies.groupBy("action_id").agg(F.first(F.struct(*log.columns)).alias("row"), F.count(F.lit(1)).alias("n"))
    differs = F.raise_error(F.concat(F.lit("different actions share the id "), F.col("action_id")))
    return per_id.select(F.when(F.col("n") == 1, F.col("row")).otherwise(differs).alias("row")).select("row.*")


def alert_rows(findings: DataFrame, title: Column, message: Column, severity: Column, details: Column) -> DataFrame:
    return findings.select(
        title.alias("title"), message.alias("message"), severity.alias("severity"), details.alias("details")
    )
