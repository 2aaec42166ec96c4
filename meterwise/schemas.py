"""One declared schema per table. Writers conform to these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, L, I, D, DATE, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.DateType(),
    T.TimestampType(),
)

# Table and column names that queries over these tables rely on.
CLUSTER_UTILIZATION = _struct(
    cluster_id=S, workspace_id=S, hour_window=TS, avg_cpu_pct=D, peak_cpu_pct=D, avg_mem_pct=D,
    peak_mem_pct=D, node_count=L, node_type_count=L, updated_at=TS,
)
JOB_COST_TREND = _struct(
    workspace_id=S, job_id=S, job_name=S, usage_date=DATE, daily_cost_usd=D, rolling_14d_avg=D,
    cost_growth_pct=D, updated_at=TS,
)
JOB_HEALTH = _struct(
    workspace_id=S, job_id=S, job_name=S, total_runs=L, failed_runs=L, failure_rate=D,
    avg_duration_secs=D, stddev_duration=D, max_duration_secs=D, updated_at=TS,
)
ACTION_LOG = _struct(
    action_id=S, action_timestamp=TS, skill_name=S, action_type=S, workspace_id=S, target_id=S,
    target_name=S, description=S, projected_savings=D, status=S, details=S,
)
CONVERSATION = _struct(
    session_id=S, turn=I, role=S, content=S, tool_name=S, tool_args=S, tool_result=S, user_id=S, ts=TS,
)
KNOWLEDGE_DOCS = _struct(doc_id=S, title=S, content=S, source=S, tags=S, updated_at=TS)
RECONCILIATION = _struct(
    check_id=S, severity=S, status=S, measured=D, tolerance=D, summary=S, detail=S, mode=S, checked_at=TS,
)

TABLES = {
    "feat_cluster_utilization": CLUSTER_UTILIZATION,
    "feat_job_cost_trend": JOB_COST_TREND,
    "feat_job_health": JOB_HEALTH,
    "agent_action_log": ACTION_LOG,
    "agent_conversation": CONVERSATION,
    "knowledge_docs": KNOWLEDGE_DOCS,
    "reconciliation_log": RECONCILIATION,
}
# Partitioned by the batch that wrote a row: a repeated batch replaces its own rows (``sinks.tables.replace_batch``).
BATCHED = {"agent_action_log", "agent_conversation"}
# Replaced as a whole: views over versions (``sinks.tables.publish_version``).
VERSIONED = {"feat_cluster_utilization", "feat_job_cost_trend", "feat_job_health"}
# In buckets of the hash of a key, here named: an upsert writes the buckets it touches (``sinks.tables.upsert_buckets``).
BUCKETED = {"knowledge_docs": "doc_id"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order and type; a missing or unknown column is an error."""
    declared, present = set(schema.fieldNames()), set(df.columns)
    if declared != present:
        raise ValueError(f"missing columns {sorted(declared - present)}, unknown {sorted(present - declared)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
