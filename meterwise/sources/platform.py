"""Platform tables in their native, nested form, and the flat form the operators read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PlatformTables:
    """The logical inputs, planned on first use so that a query touches only what it
    names, and once, so that its parts share one plan of a table."""

    def __init__(self, spark: SparkSession, read: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._read = read

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._read:
            raise AttributeError(name)
        table = self._read[name]()
        setattr(self, name, table)
        return table


def _native(spark: SparkSession, sources: Mapping[str, str], read: Callable[[str], DataFrame]) -> PlatformTables:
    shape = {"usage": flat_usage, "list_prices": flat_prices, "clusters": flat_clusters}

    def reader(logical: str, source: str) -> Callable[[], DataFrame]:
        return lambda: shape.get(logical, lambda df: df)(read(source))

    return PlatformTables(spark, {logical: reader(logical, source) for logical, source in sources.items()})


def from_catalog(spark: SparkSession, names: Mapping[str, str]) -> PlatformTables:
    """``names`` maps a logical table (``usage``, ``list_prices``, ``jobs``, ``clusters``,
    ``node_timeline``, ``job_run_timeline``, ``job_task_run_timeline``, ...) to a catalog
    table in its native form."""
    return _native(spark, names, spark.table)


def from_parquet(spark: SparkSession, paths: Mapping[str, str]) -> PlatformTables:
    """As ``from_catalog``, from parquet folders."""
    return _native(spark, paths, spark.read.parquet)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """A few rows made by a program, such as one turn or one action, under a declared
    schema; nothing is inferred."""
    return spark.createDataFrame(list(rows), schema)


def flat_usage(usage: DataFrame) -> DataFrame:
    """Lift the job, cluster and team tag out of their struct and map columns."""
    metadata = usage.schema["usage_metadata"].dataType.fieldNames()
    cluster = F.col("usage_metadata.cluster_id") if "cluster_id" in metadata else F.lit(None).cast("string")
    return usage.select(
        "workspace_id",
        F.col("usage_metadata.job_id").alias("job_id"),
        cluster.alias("cluster_id"),
        "usage_date",
        "usage_start_time",
        "sku_name",
        "cloud",
        "billing_origin_product",
        F.col("custom_tags")["team"].alias("team_tag"),
        # Decimals times decimals lose digits in a sum; doubles do not overflow.
        F.col("usage_quantity").cast("double").alias("usage_quantity"),
    )


def flat_prices(prices: DataFrame) -> DataFrame:
    return prices.select(
        "cloud",
        "sku_name",
        "price_start_time",
        "price_end_time",
        F.col("pricing.default").cast("double").alias("unit_price"),
    )


def flat_clusters(clusters: DataFrame) -> DataFrame:
    """Accepts the sizes as a struct or flat, and either name of the node type."""
    columns = set(clusters.columns)
    nested = "autoscale" in columns
    low = F.col("autoscale.min_workers" if nested else "min_autoscale_workers")
    high = F.col("autoscale.max_workers" if nested else "max_autoscale_workers")
    node = F.col("worker_node_type" if "worker_node_type" in columns else "node_type_id")
    return clusters.select(
        "cluster_id",
        "workspace_id",
        "cluster_name",
        "cluster_source",
        node.alias("worker_node_type"),
        low.cast("int").alias("min_workers"),
        high.cast("int").alias("max_workers"),
        "change_time",
        "delete_time",
    )
