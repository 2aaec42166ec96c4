from __future__ import annotations

import json
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.operators import actions, budget, sizing, spikes, waste
from meterwise.schemas import ACTION_LOG

CLUSTERS = (
    "cluster_id string, workspace_id string, cluster_name string, cluster_source string, worker_node_type string, "
    "min_workers int, max_workers int, change_time timestamp, delete_time timestamp"
)
TASKS = (
    "workspace_id string, job_id string, run_id long, compute_id string, period_start_time timestamp, "
    "period_end_time timestamp"
)
HOURLY = (
    "cluster_id string, workspace_id string, hour_window timestamp, avg_cpu_pct double, avg_mem_pct double, "
    "node_count long"
)
SPIKES = (
    "workspace_id string, job_id string, job_name string, usage_date date, daily_cost_usd double, "
    "rolling_14d_avg double, cost_growth_pct double"
)
USAGE = "workspace_id string, job_id string, usage_date date, usage_quantity double"


def cluster(cluster_id, source="JOB", name="c", changed="2024-01-01 00:00:00", deleted=None, low=1, high=4):
    return (cluster_id, "w", name, source, "n", low, high, changed, deleted)


def explain(frame, clock, cfg, spike_rows, usage, tasks, clusters):
    return spikes.spike_explanations(
        frame(spike_rows, SPIKES), frame(usage, USAGE), frame(tasks, TASKS), frame(clusters, CLUSTERS), clock, cfg
    )


def test_causes_are_listed_in_order_and_once_per_spike(frame, clock, cfg):
    explained = explain(
        frame, clock, cfg,
        [("w", "1", "job", "2024-01-30", 100.0, 50.0, 1.0), ("w", "1", "job", "2024-01-29", 80.0, 50.0, 0.6)],
        [("w", "1", "2024-01-30", 30.0), ("w", "1", "2024-01-20", 20.0)],
        [("w", "1", i, "k", "2024-01-30 00:00:00", None) for i in range(50)],
        [
            cluster("k", "UI", "mine", "2024-01-29 00:00:00", high=8),
            cluster("k", "UI", "mine", "2024-01-28 00:00:00", high=2),
        ],
    ).collect()
    assert len(explained) == 2
    first, second, third = explained[0]["root_causes"]
    assert first == "Cluster 'mine' was reconfigured on 2024-01-29 00:00:00 — node type: n, workers: 1-8"
    assert second == "DBU consumption increased 50% (20 → 30 DBUs week-over-week)"
    assert third.startswith("Job is running on ALL-PURPOSE compute")


def test_no_cause_and_no_name_fall_back(frame, clock, cfg):
    row = explain(
        frame, clock, cfg,
        [("w", "1", "", "2024-01-30", 100.0, 50.0, 1.0)],
        [("w", "1", "2024-01-30", 30.0), ("w", "1", "2024-01-20", 0.0)],  # no baseline, no growth
        [("w", "1", 1, "k", "2024-01-30 00:00:00", None)],
        [cluster("k")],  # changed long ago, not interactive
    ).first()
    assert row["target_name"] == "job_1"
    assert row["root_causes"] == ["No specific root cause identified — review job configuration manually"]
    assert row["explanation"].startswith("Job 'job_1' cost 100% more this week ($100/day).")


def test_spike_actions_have_the_log_schema_and_stable_ids(frame, clock, cfg):
    explained = explain(
        frame, clock, cfg, [("w", "1", "job", "2024-01-30", 100.0, 50.0, 0.5)], [], [], []
    )
    rows = spikes.cost_spike_actions(explained, clock)
    assert rows.schema.fieldNames() == ACTION_LOG.fieldNames()
    one, again = rows.first(), spikes.cost_spike_actions(explained, clock).first()
    assert one["action_id"] == again["action_id"]
    assert one["projected_savings"] == 1500.0
    assert json.loads(one["details"])["cost_growth_pct"] == 50.0
    later = rows.withColumn("action_timestamp", F.col("action_timestamp") + F.expr("INTERVAL 1 HOUR"))
    assert rows_of(actions.without_repeats(rows.unionByName(later))) == rows_of(rows)
    other = rows.withColumn("description", F.lit("something else"))
    with pytest.raises(Exception, match="share the id"):
        actions.without_repeats(rows.unionByName(other)).collect()


def test_a_job_on_two_clusters_gives_actions_of_their_own(frame, clock, cfg):
    wrong = frame(
        [("w", "1", "job", "a", "c", "UI", 5), ("w", "1", "job", "b", "c", "UI", 5)],
        "workspace_id string, job_id string, job_name string, cluster_id string, cluster_name string, cluster_source string, recent_runs long",
    )
    none = frame([], "cluster_id string, workspace_id string, cluster_name string, last_active_hour timestamp, recent_cpu double, idle_hours long")
    idle = frame([], "cluster_id string, workspace_id string, cluster_name string, active_tasks long")
    rows = waste.waste_actions(waste.top_waste_actions(waste.waste_items(wrong, none, idle, cfg), cfg), clock, cfg)
    assert rows.count() == 2 == actions.without_repeats(rows).count()


def hours(*spec, cluster_id="k"):
    """(hour, cpu, mem) on 30 January."""
    return [(cluster_id, "w", f"2024-01-30 {h:02d}:00:00", cpu, mem, 3) for h, cpu, mem in spec]


def test_counter_counts_rows_and_streaks_count_hours(frame, clock, cfg):
    low = [(h, 10.0, 10.0) for h in (0, 1, 2, 10, 11)]
    hourly = frame(hours(*low), HOURLY)
    counted = sizing.low_utilization_rows(hourly, clock, cfg)
    assert max(r["consecutive_low_hours"] for r in counted.collect()) == 5
    assert sizing.low_utilization_streaks(hourly, clock, cfg).count() == 0
    streaks = sizing.low_utilization_streaks(hourly, clock, cfg, min_hours=1)
    assert rows_of(streaks, "streak_hours") == [(2,), (3,)]


def test_a_busy_row_breaks_the_counter(frame, clock, cfg):
    spec = [(h, 10.0, 10.0) for h in range(4)] + [(4, 90.0, 10.0)] + [(h, 10.0, 10.0) for h in range(5, 9)]
    hourly = frame(hours(*spec), HOURLY)
    assert sizing.overprovisioned_clusters(hourly, frame([cluster("k")], CLUSTERS), clock, cfg).isEmpty()


def sized(frame, clock, cfg, clusters, cpu=15.0, mem=30.0):
    hourly = frame(hours(*[(h, cpu, mem) for h in range(6)]), HOURLY)
    return sizing.right_sizing(
        sizing.overprovisioned_clusters(hourly, frame(clusters, CLUSTERS), clock, cfg), cfg
    )


def test_right_sizing_arithmetic(frame, clock, cfg):
    row = sized(frame, clock, cfg, [cluster("k", low=2, high=10)]).first()
    # 30 / 60 of ten workers
    assert (row["optimal_max"], row["optimal_min"], row["reduction_pct"]) == (5, 2, 0.5)
    assert row["estimated_monthly_savings"] == 0.5 * 10 * 720 * 0.15


def test_null_and_zero_sizes_take_defaults(frame, clock, cfg):
    for nothing in (None, 0):
        row = sized(frame, clock, cfg, [cluster("k", low=nothing, high=nothing)]).first()
        assert (row["current_min"], row["current_max"], row["optimal_max"], row["optimal_min"]) == (1, 3, 1, 1)


def test_sizing_never_recommends_growth(frame, clock, cfg):
    busy_later = hours(*[(h, 10.0, 10.0) for h in range(5)], *[(h, 100.0, 100.0) for h in range(5, 24)])
    candidates = sizing.overprovisioned_clusters(
        frame(busy_later, HOURLY), frame([cluster("k")], CLUSTERS), clock, cfg
    )
    assert candidates.count() == 1
    assert sizing.right_sizing(candidates, cfg).isEmpty()


def test_cluster_without_configuration_drops_out(frame, clock, cfg):
    assert sized(frame, clock, cfg, [cluster("other")]).isEmpty()


def test_approval_gate(frame, clock, cfg):
    rows = sized(frame, clock, cfg, [cluster("k", high=10)])
    held = sizing.right_sizing_actions(rows, clock, cfg).first()
    free = sizing.right_sizing_actions(rows, clock, replace(cfg, require_approval=False)).first()
    assert (held["status"], held["action_type"]) == ("proposed", "recommendation")
    assert (free["status"], free["action_type"]) == ("applied", "auto_remediation")


def test_interactive_jobs_count_runs_not_joined_versions(frame, clock):
    tasks = frame(
        [("w", "1", r, "k", "2024-01-30 00:00:00", None) for r in (1, 1, 1, 2)], TASKS
    )
    clusters = frame(
        [cluster("k", "UI", changed=f"2024-01-0{d} 00:00:00") for d in (1, 2, 3)]
        + [cluster("was-ui", "UI"), cluster("was-ui", "JOB", changed="2024-01-05 00:00:00")],
        CLUSTERS,
    )
    jobs = frame(
        [("w", "1", n, f"2024-01-0{d} 00:00:00") for d, n in ((1, "a"), (2, "b"))],
        "workspace_id string, job_id string, name string, change_time timestamp",
    )
    found = waste.jobs_on_interactive_compute(tasks, clusters, jobs, clock)
    assert rows_of(found, "job_name", "cluster_id", "recent_runs") == [("b", "k", 2)]


def test_idle_logic_is_three_valued(frame, clock, cfg):
    hourly = frame(
        [
            ("low", "w", "2024-01-30 23:00:00", 1.0, 10.0, 1),
            ("busy", "w", "2024-01-30 23:00:00", 50.0, 10.0, 1),
            ("quiet", "w", "2024-01-30 20:00:00", 50.0, 10.0, 1),
            ("edge", "w", "2024-01-30 22:00:00", 50.0, 10.0, 1),  # exactly two hours ago
            ("unknown-cpu", "w", "2024-01-30 23:00:00", None, None, 1),
        ],
        HOURLY,
    )
    names = ["low", "busy", "quiet", "edge", "unknown-cpu", "silent", "gone"]
    clusters = frame([cluster(n, deleted="2024-01-30 00:00:00" if n == "gone" else None) for n in names], CLUSTERS)
    found = waste.idle_clusters(hourly, clusters, clock, cfg)
    assert rows_of(found, "cluster_id", "idle_hours") == [("low", 1), ("quiet", 4), ("silent", None)]


def test_zero_task_clusters_need_an_open_recent_task(frame, clock):
    clusters = frame([cluster(n) for n in ("open", "closed", "old", "none")], CLUSTERS)
    tasks = frame(
        [
            ("w", "1", 1, "open", "2024-01-30 22:00:00", None),
            ("w", "1", 2, "closed", "2024-01-30 22:00:00", "2024-01-30 23:00:00"),
            ("w", "1", 3, "old", "2024-01-30 19:00:00", None),
        ],
        TASKS,
    )
    assert rows_of(waste.zero_task_clusters(tasks, clusters, clock), "cluster_id") == [("closed",), ("none",), ("old",)]


def test_waste_defaults_and_tie_order(frame, clock, cfg):
    wrong = frame([("w", "7", None, "k", 4)], "workspace_id string, job_id string, job_name string, cluster_id string, recent_runs long")
    idle = frame(
        [("a", "w", None, None), ("b", "w", "b", 0), ("c", "w", "c", 10)],
        "cluster_id string, workspace_id string, cluster_name string, idle_hours long",
    )
    none = frame([("z", "w", "z")], "cluster_id string, workspace_id string, cluster_name string")
    items = waste.waste_items(wrong, idle, none, cfg)
    top = waste.top_waste_actions(items, cfg).orderBy("rank").collect()
    # 35 for ten idle hours; 20 twice, by category; then the default of two hours
    assert [(r["category"], r["target"], r["weekly_savings"]) for r in top] == [
        ("idle_cluster", "c", 35.0),
        ("wrong_compute", "job_7", 20.0),
        ("zero_tasks", "z", 20.0),
        ("idle_cluster", "a", 7.0),
        ("idle_cluster", "b", 7.0),
    ]
    total = waste.waste_summary(items).first()
    assert (total["total_items"], total["top_weekly_savings"]) == (5, 89.0)


def test_waste_summary_of_nothing(frame, clock, cfg):
    items = frame([], "category string, target string, description string, weekly_savings double")
    total = waste.waste_summary(items).first()
    assert (total["total_items"], total["top_weekly_savings"]) == (0, 0.0)


def projection(frame, *rows):
    return frame(
        list(rows), "workspace_id string, mtd_spend double, avg_daily_spend double, linear_projection double"
    )


def test_guardrail_defaults_severity_and_zero_budget(spark, frame, cfg):
    cfg = replace(cfg, budgets={"a": 100.0, "zero": 0.0}, default_budget=1000.0)
    rows = projection(
        frame, ("a", 90.0, 3.0, 100.5), ("b", 900.0, 30.0, 900.0), ("c", 1.0, 1.0, 899.0), ("zero", 5.0, 1.0, 5.0)
    )
    used = budget.budget_use(rows, budget.budget_table(spark, cfg), cfg)
    found = rows_of(budget.budget_guardrail(used), "workspace_id", "budget", "severity")
    assert found == [("a", 100.0, "critical"), ("b", 1000.0, "warning")]


def test_no_configured_budgets(spark, frame, cfg):
    used = budget.budget_use(projection(frame, ("a", 1.0, 1.0, 50000.0)), budget.budget_table(spark, cfg), cfg)
    assert used.first()["budget_pct"] == 100.0


def test_budget_alert_text(spark, frame, clock, cfg):
    cfg = replace(cfg, budgets={"a": 1000.0})
    rows = projection(frame, ("a", 1234.5, 40.0, 1500.4), ("quiet", 1.0, 1.0, 1.0))
    drivers = frame(
        [("a", 2, "y", 20.5), ("a", 1, None, 12345678.25)],
        "workspace_id string, rank long, job_name string, mtd_cost double",
    )
    used = budget.budget_use(rows, budget.budget_table(spark, cfg), cfg)
    alert = budget.budget_alerts(used, drivers).collect()
    assert [r["description"] for r in alert] == [
        "Workspace a: projected EOM spend $1,500 (150% of $1,000 budget). MTD: $1,235, avg $40/day. "
        "Top drivers: None ($12345678.25), y ($20.5)."
    ]
    without = budget.budget_alerts(used, drivers.where("false")).first()["description"]
    assert without.endswith("Top drivers: N/A.")
    details = json.loads(budget.budget_actions(budget.budget_alerts(used, drivers), clock).first()["details"])
    assert [d["cost"] for d in details["top_drivers"]] == [12345678.25, 20.5]


def test_manual_actions_take_defaults(frame, clock):
    requests = frame(
        [("agent", "alert", "w", "t", "name", "text", None, None, None)],
        "skill_name string, action_type string, workspace_id string, target_id string, target_name string, "
        "description string, projected_savings double, status string, details string",
    )
    row = actions.log_actions(requests, clock).first()
    assert (row["projected_savings"], row["status"], row["details"]) == (0.0, "proposed", "{}")
