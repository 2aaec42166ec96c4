"""Wall clock of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_COMPARE=1 to
full, into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from meterwise.operators import spikes
from meterwise.operators.features import cluster_hourly_utilization, stamped
from meterwise.operators.reports import cost_by_sku, cost_current_month_trajectory, cost_monthly_summary
from meterwise.operators.versions import priced_usage
from meterwise.plans.catalogue import Inputs, queries
from meterwise.session import build_session, settle
from meterwise.sources.driver_tables import CLOCK, CONFIG

HEADLINE = [
    "priced_usage",
    "job_cost_trend",
    "cluster_hourly_utilization",
    "job_health",
    "top_cost_spikes",
    "latest_run_anomalies",
    "spike_explanations",
    "right_sizing",
    "waste_items",
    "budget_guardrail",
    "all_actions",
    "cost_monthly_summary",
    "cost_current_month_trajectory",
    "cost_by_sku",
    "cluster_utilization_heatmap",
    "job_daily_failure_trend",
    "job_sla_breach_runs",
    "monthly_digest",
    "cluster_resizes",
    "workspace_comparison",
    "recon_summary",
    "recent_turns",
    "assign_turns",
    "upsert_documents",
    "changed_documents",
    "semantic_topk",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def causes_per_spike(i: Inputs) -> None:
    """The loop that set-based root cause replaces: three queries for each spike."""
    t = i.t
    for spike in i.found.spikes.collect():
        one = (F.col("workspace_id") == spike["workspace_id"]) & (F.col("job_id") == spike["job_id"])
        tasks, usage = t.job_task_run_timeline.where(one), t.usage.where(one)
        spikes.reconfigured_clusters(tasks, t.clusters, CLOCK).collect()
        spikes.grown_volume(usage, CLOCK, CONFIG).collect()
        spikes.jobs_on_interactive_clusters(tasks, t.clusters, CLOCK).collect()


def three_cost_reports(usage, prices) -> None:
    for report in (cost_monthly_summary, cost_current_month_trajectory, cost_by_sku):
        run(report(usage, prices, CLOCK, CONFIG))


def reports_over_settled_prices(i: Inputs) -> None:
    """The price join once, at the grain that the three reports need."""
    t = i.t
    recent = t.usage.where(CLOCK.dates_since("usage_date", CLOCK.months_ago(6)))
    per_day = priced_usage(recent, t.list_prices, CONFIG).groupBy(
        "workspace_id", "job_id", "usage_date", "sku_name", "billing_origin_product"
    ).agg(F.sum("cost_usd").alias("cost_usd"), F.sum("usage_quantity").alias("usage_quantity"))
    daily = settle(per_day, "daily-spend")
    run(daily.groupBy(F.date_trunc("month", "usage_date")).agg(
        F.sum("cost_usd"), F.count_distinct("workspace_id"), F.count_distinct("job_id")))
    month = daily.where(CLOCK.dates_since("usage_date", CLOCK.month_start))
    run(month.groupBy("usage_date").agg(F.sum("cost_usd")))
    run(month.groupBy("sku_name", "billing_origin_product").agg(F.sum("cost_usd"), F.sum("usage_quantity")))


def counted_then_written(i: Inputs) -> None:
    """A feature evaluated for its count and again for the write."""
    feature = stamped(cluster_hourly_utilization(i.t.node_timeline, CLOCK, CONFIG), CLOCK)
    feature.count()
    run(feature)


def warm(action) -> float:
    """The second of two runs, so that the order of a pair does not matter."""
    action()
    return timed(action)


def comparisons(i: Inputs) -> dict[str, float]:
    return {
        "root_cause_set_based": warm(lambda: run(i.found.explained_spikes)),
        "root_cause_per_spike": timed(lambda: causes_per_spike(i)),
        "cost_reports_each_join": warm(lambda: three_cost_reports(i.t.usage, i.t.list_prices)),
        "cost_reports_one_join": warm(lambda: reports_over_settled_prices(i)),
        "feature_written_once": warm(lambda: run(i.f.hourly)),
        "feature_counted_then_written": warm(lambda: counted_then_written(i)),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    names = sys.argv[1:] or HEADLINE
    run(known["job_cost_trend"](spark, folder))  # start the workers and the code cache
    times = {name: timed(lambda: run(known[name](spark, folder))) for name in names}
    result = {
        "metric": "headline_queries_wall_clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        result["comparisons"] = comparisons(Inputs(spark, folder))
    print(json.dumps(result))


if __name__ == "__main__":
    main()
