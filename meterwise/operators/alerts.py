"""Alert payloads as rows. Delivery is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.numeric import whole_number
from meterwise.operators.actions import alert_rows

# Titles, wording and field names of the payloads.
BUDGET_TITLE = "Budget Alert: %d%% of Budget"
WASTE_TITLE = "Wasteful Compute Report"
WASTE_TEXT = "Found %d optimization(s). Top 5 save ~$%d/week."


def _dollars(column: str):
    return F.format_string("$%,d", whole_number(F.col(column)))


def alerts(budget_alert_rows: DataFrame, waste_totals: DataFrame) -> DataFrame:
    """(title, message, severity, details) for budgets and for waste."""
    budget = alert_rows(
        budget_alert_rows,
        F.format_string(BUDGET_TITLE, whole_number(F.col("budget_pct"))),
        F.col("description"),
        F.col("severity"),
        F.create_map(
            F.lit("Workspace"), F.col("workspace_id"),
            F.lit("MTD Spend"), _dollars("mtd_spend"),
            F.lit("Projected"), _dollars("linear_projection"),
            F.lit("Budget"), _dollars("budget"),
        ),
    )
    saving = whole_number(F.col("top_weekly_savings"))
    waste = alert_rows(
        waste_totals.where(F.col("total_items") > 0),
        F.lit(WASTE_TITLE),
        F.format_string(WASTE_TEXT, "total_items", saving),
        F.lit("warning"),
        F.create_map(
            F.lit("Total items"), F.col("total_items").cast("string"),
            F.lit("Est. weekly savings"), F.format_string("$%d", saving),
        ),
    )
    return budget.unionByName(waste)
