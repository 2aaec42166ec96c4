"""The feature tables of one refresh."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.operators import features as f
from meterwise.session import settle
from meterwise.sources.platform import PlatformTables


class Features:
    """The three features, each planned on first use."""

    def __init__(self, tables: PlatformTables, clock: Clock, cfg: Config):
        self._tables, self._clock, self._cfg = tables, clock, cfg

    @cached_property
    def hourly(self) -> DataFrame:
        plain = f.cluster_hourly_utilization(self._tables.node_timeline, self._clock, self._cfg)
        return f.stamped(plain, self._clock)

    @cached_property
    def trend(self) -> DataFrame:
        t = self._tables
        return f.stamped(f.job_cost_trend(t.usage, t.list_prices, t.jobs, self._clock, self._cfg), self._clock)

    @cached_property
    def health(self) -> DataFrame:
        t = self._tables
        return f.stamped(f.job_health(t.job_run_timeline, t.jobs, self._clock, self._cfg), self._clock)


class SettledFeatures(Features):
    """Features written once to the shared folder, for plans with many readers."""

    @cached_property
    def hourly(self) -> DataFrame:
        return settle(super().hourly, "hourly")

    @cached_property
    def trend(self) -> DataFrame:
        return settle(super().trend, "trend")

    @cached_property
    def health(self) -> DataFrame:
        return settle(super().health, "health")


class StoredFeatures:
    """Features read back from the tables of the last refresh."""

    def __init__(self, spark, database: str):
        self._table = lambda name: spark.table(f"{database}.{name}")

    hourly = property(lambda self: self._table("feat_cluster_utilization"))
    trend = property(lambda self: self._table("feat_job_cost_trend"))
    health = property(lambda self: self._table("feat_job_health"))
