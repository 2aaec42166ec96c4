"""All thresholds in one place."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # The thresholds that decide which rows a query returns.
    spike_growth_pct: float = 25.0
    volume_growth_pct: float = 10.0
    budget_alert_pct: float = 90.0
    default_budget: float = 50_000.0
    budgets: Mapping[str, float] = field(default_factory=dict)
    low_cpu_pct: float = 30.0
    low_mem_pct: float = 40.0
    low_util_rows: int = 5
    idle_hours: int = 2
    idle_cpu_pct: float = 5.0
    anomaly_sigma: float = 2.0
    health_lookback_days: int = 30
    sla_minutes: int = 60
    min_runs_to_rank: int = 5
    sizing_target_pct: float = 60.0
    sizing_headroom_pct: float = 25.0
    hours_per_month: int = 720
    worker_hour_rate: float = 0.15
    weekly_saving_per_run: float = 5.0
    saving_per_idle_hour: float = 0.5
    days_per_week: int = 7
    weekly_saving_zero_tasks: float = 20.0
    weeks_per_month: float = 4.3
    require_approval: bool = True
    utilization_days: int = 30
    cost_days: int = 60

    # Physical bounds, not semantics: results do not depend on them.
    broadcast_rows: int = 100_000
    """A join side is broadcast only if a count shows at most this many rows."""
    salt_buckets: int = 64
    """Slices per key when the side is too large to broadcast."""
    version_slot_hours: int = 24
    """Width of the time slots in which facts meet a long list of versions."""
    query_vectors_per_task: int = 1_024
    """Query vectors held by one task in a similarity search."""

    @property
    def spike_growth(self) -> float:
        return self.spike_growth_pct / 100
