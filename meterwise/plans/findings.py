"""The four findings, each from features and platform tables to action rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.operators import actions, alerts, budget, sizing, spikes, waste
from meterwise.plans.features import Features
from meterwise.session import settle
from meterwise.sources.platform import PlatformTables


class Findings:
    def __init__(self, features: Features, tables: PlatformTables, clock: Clock, cfg: Config):
        self.features, self.tables, self.clock, self.cfg = features, tables, clock, cfg

    @cached_property
    def spikes(self) -> DataFrame:
        return spikes.cost_spikes(self.features.trend, self.clock, self.cfg)

    @cached_property
    def explained_spikes(self) -> DataFrame:
        t = self.tables
        return spikes.spike_explanations(
            settle(self.spikes, "spikes"), t.usage, t.job_task_run_timeline, t.clusters, self.clock, self.cfg
        )

    @cached_property
    def overprovisioned(self) -> DataFrame:
        return sizing.overprovisioned_clusters(self.features.hourly, self.tables.clusters, self.clock, self.cfg)

    @cached_property
    def right_sized(self) -> DataFrame:
        return sizing.right_sizing(self.overprovisioned, self.cfg)

    @cached_property
    def waste_items(self) -> DataFrame:
        t = self.tables
        return waste.waste_items(
            waste.jobs_on_interactive_compute(t.job_task_run_timeline, t.clusters, t.jobs, self.clock),
            waste.idle_clusters(self.features.hourly, t.clusters, self.clock, self.cfg),
            waste.zero_task_clusters(t.job_task_run_timeline, t.clusters, self.clock),
            self.cfg,
        )

    @cached_property
    def daily_spend(self) -> DataFrame:
        return budget.workspace_daily_spend(self.tables.usage, self.tables.list_prices, self.clock, self.cfg)

    @cached_property
    def projection(self) -> DataFrame:
        return budget.budget_projection(self.daily_spend, self.clock)

    @cached_property
    def budgets(self) -> DataFrame:
        return budget.budget_table(self.tables.spark, self.cfg)

    @cached_property
    def budget_use(self) -> DataFrame:
        return budget.budget_use(self.projection, self.budgets, self.cfg)

    @cached_property
    def guardrail(self) -> DataFrame:
        return budget.budget_guardrail(self.budget_use)

    @cached_property
    def workspace_drivers(self) -> DataFrame:
        return budget.workspace_top_drivers(self.features.trend, self.clock)

    @cached_property
    def budget_alerts(self) -> DataFrame:
        return budget.budget_alerts(self.budget_use, self.workspace_drivers)

    @cached_property
    def spike_actions(self) -> DataFrame:
        return spikes.cost_spike_actions(self.explained_spikes, self.clock)

    @cached_property
    def sizing_actions(self) -> DataFrame:
        return sizing.right_sizing_actions(self.right_sized, self.clock, self.cfg)

    @cached_property
    def waste_actions(self) -> DataFrame:
        top = waste.top_waste_actions(self.waste_items, self.cfg)
        return waste.waste_actions(top, self.clock, self.cfg)

    @cached_property
    def budget_actions(self) -> DataFrame:
        return budget.budget_actions(self.budget_alerts, self.clock)

    @cached_property
    def all_actions(self) -> DataFrame:
        return actions.all_actions(
            self.spike_actions, self.sizing_actions, self.waste_actions, self.budget_actions
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts.alerts(self.budget_alerts, waste.waste_summary(self.waste_items))
