"""Month projections, budgets and their alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.functions.numeric import plain_text, steady_round, whole_number
from meterwise.functions.versioning import top_per_key
from meterwise.operators.actions import action_rows
from meterwise.operators.versions import priced_usage

# The wording of a budget alert.
BUDGET_TEXT = (
    "Workspace %s: projected EOM spend $%,d (%d%% of $%,d budget). MTD: $%,d, avg $%,d/day. Top drivers: %s."
)
DRIVER_TEXT = "%s ($%s)"
NO_DRIVERS = "N/A"


def month_usage(usage: DataFrame, clock: Clock) -> DataFrame:
    return usage.where(clock.dates_since("usage_date", clock.month_start))


def workspace_daily_spend(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    return (
        priced_usage(month_usage(usage, clock), prices, cfg)
        .groupBy("workspace_id", "usage_date")
        .agg(F.sum("cost_usd").alias("daily_cost_usd"))
    )


def _month_to_date(daily: DataFrame, clock: Clock) -> DataFrame:
    return daily.groupBy("workspace_id").agg(
        F.sum("daily_cost_usd").alias("mtd"),
        F.avg("daily_cost_usd").alias("per_day"),
        F.count(F.lit(1)).alias("days_elapsed"),
        F.day(F.last_day(clock.today)).cast("long").alias("days_in_month"),
    )


def budget_projection(daily: DataFrame, clock: Clock) -> DataFrame:
    """Two projections to the month's end. ``days_elapsed`` counts days with spend."""
    rest = F.col("days_in_month") - F.col("days_elapsed")
    return _month_to_date(daily, clock).select(
        "workspace_id",
        steady_round(F.col("mtd"), 2).alias("mtd_spend"),
        steady_round(F.col("per_day"), 2).alias("avg_daily_spend"),
        "days_elapsed",
        "days_in_month",
        steady_round(F.col("per_day") * F.col("days_in_month"), 2).alias("projected_eom_spend"),
        steady_round(F.col("mtd") + F.col("per_day") * rest, 2).alias("linear_projection"),
    )


def budget_projection_calendar(daily: DataFrame, clock: Clock) -> DataFrame:
    """Variant: the pace per calendar day so far, whether or not it had spend."""
    elapsed = F.lit(clock.day.day).cast("long")
    return _month_to_date(daily, clock).select(
        "workspace_id",
        steady_round(F.col("mtd"), 2).alias("mtd_spend"),
        elapsed.alias("calendar_days_elapsed"),
        "days_in_month",
        steady_round(F.col("mtd") / elapsed * F.col("days_in_month"), 2).alias("calendar_projection"),
    )


def spend_by_tag(usage: DataFrame, prices: DataFrame, clock: Clock, cfg: Config) -> DataFrame:
    tagged = month_usage(usage, clock).where(F.col("team_tag").isNotNull())
    return (
        priced_usage(tagged, prices, cfg)
        .groupBy("workspace_id", "team_tag")
        .agg(steady_round(F.sum("cost_usd"), 2).alias("mtd_spend"))
    )


def budget_table(spark: SparkSession, cfg: Config) -> DataFrame:
    """The configured budgets as (workspace_id, budget)."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(k) for k in cfg.budgets]).cast("array<string>"),
        F.array(*[F.lit(float(v)) for v in cfg.budgets.values()]).cast("array<double>"),
    )
    return spark.range(1).select(F.explode(pairs).alias("workspace_id", "budget"))


def with_budget(per_workspace: DataFrame, budgets: DataFrame, cfg: Config) -> DataFrame:
    return per_workspace.join(budgets, "workspace_id", "left").withColumn(
        "budget", F.coalesce("budget", F.lit(cfg.default_budget))
    )


def budget_use(projection: DataFrame, budgets: DataFrame, cfg: Config) -> DataFrame:
    """Every workspace's projection as a percentage of its budget."""
    percent = F.when(F.col("budget") > 0, F.col("linear_projection") / F.col("budget") * 100).otherwise(0.0)
    severity = F.when(F.col("budget_pct") > 100, "critical").otherwise("warning")
    used = with_budget(projection, budgets, cfg).withColumn("budget_pct", percent)
    return used.withColumn("severity", F.when(F.col("budget_pct") >= cfg.budget_alert_pct, severity))


def budget_guardrail(used: DataFrame) -> DataFrame:
    """The workspaces at or above the alert percentage."""
    return used.where(F.col("severity").isNotNull()).select(
        "workspace_id", "linear_projection", "budget", "budget_pct", "severity"
    )


def workspace_top_drivers(trend: DataFrame, clock: Clock, limit: int = 3) -> DataFrame:
    """The dearest job names of each workspace, month to date."""
    spend = (
        trend.where(clock.dates_since("usage_date", clock.month_start))
        .groupBy("workspace_id", "job_name")
        .agg(steady_round(F.sum("daily_cost_usd"), 2).alias("mtd_cost"))
    )
    order = [F.desc("mtd_cost"), F.asc_nulls_first("job_name")]
    return top_per_key(spend, ["workspace_id"], order, limit, rank="rank").select(
        "workspace_id", F.col("rank").cast("long").alias("rank"), "job_name", "mtd_cost"
    )


def budget_top_drivers(guardrail: DataFrame, drivers: DataFrame) -> DataFrame:
    """The drivers of the alerting workspaces."""
    return drivers.join(guardrail.select("workspace_id"), "workspace_id", "left_semi")


def budget_alerts(used: DataFrame, drivers: DataFrame) -> DataFrame:
    """The alerting rows of ``budget_use`` with their drivers folded in and a sentence."""
    # ``workspace_top_drivers`` has limited each list.
    listed = F.sort_array(
        F.collect_list(F.struct("rank", F.col("job_name").alias("name"), F.col("mtd_cost").alias("cost")))
    )
    folded = drivers.groupBy("workspace_id").agg(listed.alias("ranked"))
    named = F.transform(
        "ranked",
        lambda d: F.format_string(DRIVER_TEXT, F.coalesce(d["name"], F.lit("None")), plain_text(d["cost"])),
    )
    text = F.coalesce(F.nullif(F.array_join(named, ", "), F.lit("")), F.lit(NO_DRIVERS))
    rows = (
        used.where(F.col("severity").isNotNull())
        .join(folded, "workspace_id", "left")
        .withColumn(
            "top_drivers",
            F.transform("ranked", lambda d: F.struct(d["name"].alias("name"), d["cost"].alias("cost"))),
        )
    )
    return rows.withColumn(
        "description",
        F.format_string(
            BUDGET_TEXT,
            "workspace_id",
            whole_number(F.col("linear_projection")),
            whole_number(F.col("budget_pct")),
            whole_number(F.col("budget")),
            whole_number(F.col("mtd_spend")),
            whole_number(F.col("avg_daily_spend")),
            text,
        ),
    ).drop("ranked")


def budget_actions(alerts: DataFrame, clock: Clock) -> DataFrame:
    details = F.to_json(
        F.struct(
            "mtd_spend",
            F.col("linear_projection").alias("projected_eom"),
            "budget",
            steady_round(F.col("budget_pct"), 1).alias("budget_pct"),
            F.coalesce("top_drivers", F.array().cast("array<struct<name:string,cost:double>>")).alias("top_drivers"),
        )
    )
    return action_rows(
        alerts,
        clock,
        skill="budget_forecast",
        kind="alert",
        workspace=F.col("workspace_id"),
        target=F.col("workspace_id"),
        name=F.concat(F.lit("Workspace "), F.col("workspace_id")),
        description=F.col("description"),
        savings=F.lit(0.0),
        details=details,
    )
