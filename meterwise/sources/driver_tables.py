"""The logical inputs derived from the star-schema parquet tables.

Every derivation is a projection of a whole table: keys are mapped, no row is
left out. Times are laid on the days before ``AS_OF``.
"""

from __future__ import annotations

from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from meterwise.clock import Clock
from meterwise.config import Config
from meterwise.session import settle_once
from meterwise.sources.platform import PlatformTables, flat_clusters, flat_prices, flat_usage

AS_OF = datetime(2024, 1, 31)
CLOCK = Clock(AS_OF)
CONFIG = Config(budgets={"0": 9_000.0, "1": 10_000.0})
NOW = f"TIMESTAMP '{AS_OF}'"


def _before(seconds: str) -> str:
    return f"timestampadd(SECOND, -({seconds}), {NOW})"


def _pick(modulus: int, key: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"array({listed})[CAST({key} % {modulus} AS INT)]"


def usage(lineitem: DataFrame) -> DataFrame:
    used_on = "date_sub(DATE '2024-01-30', CAST((l_orderkey + 31 * l_linenumber) % 200 AS INT))"
    return flat_usage(
        lineitem.selectExpr(
            "CAST(l_suppkey % 4 AS STRING) AS workspace_id",
            "named_struct('job_id', CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 25 AS STRING) END)"
            " AS usage_metadata",
            f"{used_on} AS usage_date",
            f"timestampadd(HOUR, l_suppkey % 24, CAST({used_on} AS TIMESTAMP)) AS usage_start_time",
            "l_returnflag AS sku_name",
            "l_linestatus AS cloud",
            "CASE WHEN l_linenumber = 7 THEN 'SQL' ELSE 'JOBS' END AS billing_origin_product",
            "map('team', CASE WHEN l_linenumber <= 2 THEN CAST(l_partkey % 3 AS STRING) END) AS custom_tags",
            "l_quantity AS usage_quantity",
        )
    )


def list_prices(lineitem: DataFrame) -> DataFrame:
    """Three price windows per product, the last of them open."""
    products = lineitem.selectExpr("l_returnflag AS sku_name", "l_linestatus AS cloud").distinct()
    windows = """inline(array(
        struct(TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-10-15 00:00:00', 0.10D),
        struct(TIMESTAMP '2023-10-15 00:00:00', TIMESTAMP '2024-01-15 00:00:00', 0.12D),
        struct(TIMESTAMP '2024-01-15 00:00:00', CAST(NULL AS TIMESTAMP), 0.15D)
    )) AS (price_start_time, price_end_time, base)"""
    return flat_prices(
        products.selectExpr("sku_name", "cloud", windows).selectExpr(
            "sku_name",
            "cloud",
            "price_start_time",
            "price_end_time",
            "named_struct('default', base + (ascii(sku_name) % 4) / 100.0D) AS pricing",
        )
    )


def jobs(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "CAST(p_partkey % 4 AS STRING) AS workspace_id",
        "CAST(p_partkey % 25 AS STRING) AS job_id",
        "p_name AS name",
        f"{_before('(p_partkey * 7919) % 15552000')} AS change_time",
    )


def clusters(part: DataFrame) -> DataFrame:
    age = "((p_partkey % 20) * 2 + (p_partkey * 7) % 45) * 86400 + p_partkey % 86400"
    return flat_clusters(
        part.selectExpr(
            "CAST(p_partkey % 20 AS STRING) AS cluster_id",
            "CAST(p_partkey % 4 AS STRING) AS workspace_id",
            "p_name AS cluster_name",
            "CASE WHEN p_partkey % 3 = 0 THEN 'UI' ELSE 'JOB' END AS cluster_source",
            "p_type AS worker_node_type",
            "named_struct('min_workers', greatest(1, p_size div 4), 'max_workers', p_size) AS autoscale",
            f"{_before(age)} AS change_time",
            f"CASE WHEN p_partkey % 7 = 0 THEN {NOW} END AS delete_time",
        )
    )


def node_timeline(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CAST(user_id % 20 AS STRING) AS cluster_id",
        "CAST(user_id % 4 AS STRING) AS workspace_id",
        "user_id AS instance_id",
        "CAST(user_id % 3 AS STRING) AS node_type",
        "CAST(ts AS TIMESTAMP) AS start_time",
        "least(100.0D, value * (1 + user_id % 20) / 20.0D) AS cpu_user_percent",
        "CAST((event_id * 37) % 70 AS DOUBLE) AS mem_used_percent",
    )


def job_run_timeline(orders: DataFrame) -> DataFrame:
    """Up to three periods for each run, the state in the last of them."""
    start = _before("(1 + o_orderkey % 1000) * 3600 - p * 1200")
    duration = """CAST(floor(o_totalprice) AS BIGINT) % 1200
        + CASE WHEN o_custkey % 25 = 3 THEN 5400 ELSE 0 END
        + CASE WHEN o_orderkey % 1000 < 48 AND o_custkey % 3 = 0 THEN 9000 ELSE 0 END"""
    return orders.selectExpr("*", "explode(sequence(0, CAST(o_custkey % 3 AS INT))) AS p").selectExpr(
        "CAST(o_custkey % 4 AS STRING) AS workspace_id",
        "CAST(o_custkey % 25 AS STRING) AS job_id",
        "o_orderkey AS run_id",
        f"{start} AS period_start_time",
        f"timestampadd(SECOND, {duration}, {start}) AS period_end_time",
        """CASE WHEN p < o_custkey % 3 OR o_orderkey % 20 = 1 THEN NULL
                WHEN o_orderkey % (3 + o_custkey % 7) = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS result_state""",
    )


def job_task_run_timeline(runs: DataFrame) -> DataFrame:
    return runs.selectExpr(
        "workspace_id",
        "job_id",
        "run_id",
        "CAST(run_id % 20 AS STRING) AS compute_id",
        "period_start_time",
        "CASE WHEN run_id % 20 <> 1 THEN period_end_time END AS period_end_time",
    )


def agent_action_log(customer: DataFrame) -> DataFrame:
    skills = ("cost_spike_alert", "cluster_right_sizing", "wasteful_compute_detector", "budget_forecast")
    kinds = ("alert", "recommendation", "auto_remediation")
    statuses = ("approved", "applied", "rejected", "proposed", "proposed")
    return customer.selectExpr(
        "CAST(c_custkey AS STRING) AS action_id",
        f"{_before('(1 + c_custkey % 2000) * 3600')} AS action_timestamp",
        f"{_pick(4, 'c_custkey', *skills)} AS skill_name",
        f"{_pick(3, 'c_custkey', *kinds)} AS action_type",
        "CAST(c_custkey % 4 AS STRING) AS workspace_id",
        "CAST(c_custkey % 25 AS STRING) AS target_id",
        "c_name AS target_name",
        "c_mktsegment AS description",
        "c_acctbal AS projected_savings",
        f"{_pick(5, 'c_custkey', *statuses)} AS status",
        """CASE WHEN c_custkey % 50 = 0 THEN '{bad' ELSE '{"k": 1}' END AS details""",
    )


def agent_conversation(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr(
        "CAST(conv_id AS STRING) AS session_id", "CAST(turn AS INT) AS turn", "role", "text AS content"
    )


def new_turns(conversations: DataFrame) -> DataFrame:
    """Every message once more, ``seq`` being the order of arrival."""
    return conversations.selectExpr(
        "CAST(conv_id AS STRING) AS session_id", "CAST(turn AS BIGINT) AS seq", "role", "text AS content"
    )


def knowledge_docs(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "CAST(doc_id AS STRING) AS doc_id",
        "concat_ws(' ', lang, source) AS title",
        "text AS content",
        "source",
        "concat_ws(',', lang, source) AS tags",
        f"{NOW} - INTERVAL 1 DAY AS updated_at",
    )


def new_documents(documents: DataFrame, labels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """An incoming batch: labelled documents come back with a quality tag, and each
    benchmark item is a new document."""
    quality = labels.selectExpr(
        "CAST(doc_id AS STRING) AS doc_id", "CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS quality"
    )
    known = knowledge_docs(documents).join(quality, "doc_id").selectExpr(
        "doc_id", "title", "content", "source", "concat_ws(',', tags, quality) AS tags", f"{NOW} AS updated_at"
    )
    fresh = benchmark.selectExpr(
        "concat('bench-', item_id) AS doc_id",
        "'benchmark item' AS title",
        "text AS content",
        "'benchmark' AS source",
        "'benchmark' AS tags",
        f"{NOW} AS updated_at",
    )
    return known.unionByName(fresh)


def document_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.selectExpr("vec_id AS doc_id", "embedding AS vector", "label")


def load(spark: SparkSession, directory: str) -> PlatformTables:
    @cache
    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    tables = PlatformTables(
        spark,
        {
            "usage": lambda: usage(raw("lineitem")),
            # Written once per application, as a price list is a table and not a scan of the usage.
            "list_prices": lambda: settle_once(
                spark, "list-prices", directory, lambda: list_prices(raw("lineitem"))
            ),
            "jobs": lambda: jobs(raw("part")),
            "clusters": lambda: clusters(raw("part")),
            "node_timeline": lambda: node_timeline(raw("events")),
            "job_run_timeline": lambda: job_run_timeline(raw("orders")),
            "job_task_run_timeline": lambda: job_task_run_timeline(tables.job_run_timeline),
            "agent_action_log": lambda: agent_action_log(raw("customer")),
            "agent_conversation": lambda: agent_conversation(raw("conversations")),
            "new_turns": lambda: new_turns(raw("conversations")),
            "knowledge_docs": lambda: knowledge_docs(raw("documents")),
            "new_documents": lambda: new_documents(raw("documents"), raw("labels"), raw("benchmark")),
            "document_vectors": lambda: document_vectors(raw("embeddings")),
        },
    )
    return tables
