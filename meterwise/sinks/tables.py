"""Catalog tables: create, overwrite, append, upsert, view."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Collection
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.clock import date_literal
from meterwise.schemas import BATCHED, BUCKETED, TABLES, VERSIONED, conform
from meterwise.session import settle
from meterwise.streaming.common import merge_batch, parts

BATCH = "batch"
BUCKET = "bucket"
# A table of 10 TB wants some 16,384, so that a bucket is rewritten in less than a GB. Fixed when a table is created.
BUCKETS = 64


def create_table_if_missing(spark: SparkSession, table: str, schema: T.StructType, batched: bool = False) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if batched:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {BATCH} string) USING parquet PARTITIONED BY ({BATCH})")
    else:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def create_all(spark: SparkSession, database: str) -> None:
    for name, schema in TABLES.items():
        table = f"{database}.{name}"
        if name in BUCKETED:
            create_buckets_if_missing(spark, table, schema)
        elif name not in VERSIONED:
            create_table_if_missing(spark, table, schema, name in BATCHED)
        elif not spark.catalog.tableExists(table):
            publish_version(spark.createDataFrame([], schema), table)


def overwrite_table(df: DataFrame, table: str, schema: T.StructType, partition_by: str | None = None) -> None:
    """Replace a table and its schema, in one action."""
    rows = conform(df, schema)
    writer = rows.hint("rebalance").write
    if partition_by:
        # Rows of one date meet in few files, while a heavy date is still split.
        writer = rows.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.mode("overwrite").format("parquet").saveAsTable(table)


def append_rows(df: DataFrame, table: str, schema: T.StructType) -> None:
    conform(df, schema).write.mode("append").format("parquet").saveAsTable(table)


def replace_batch(df: DataFrame, table: str, schema: T.StructType, batch: str) -> None:
    """Make ``df`` the rows of one batch of a batched table. A job that is repeated with its batch's name replaces what
    it wrote before, rows that are gone included, and touches no other batch; so a retry
    neither doubles nor drops rows, and nothing needs to be compared with the log."""
    if not re.fullmatch(r"[\w.:-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    rows = conform(df, schema)
    rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{batch}') SELECT * FROM {{rows}}", rows=rows)


def create_day_table_if_missing(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """A table partitioned by its last column, a date. What overwrites it replaces the partitions it has rows for."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    kind = f"USING parquet OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({schema.fields[-1].name})"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) {kind}")


def replace_days(df: DataFrame, table: str, column: str, days: Collection[date]) -> None:
    """Make ``df`` the rows of ``days`` in a table of ``create_day_table_if_missing`` with date ``column``. Other
    partitions keep their files; days without rows any more are dropped. Doing it again gives the same table."""
    spark = df.sparkSession
    rows = settle(df.where(F.col(column).isin([date_literal(d) for d in days])).hint("rebalance", column), "days")
    held = {r[0] for r in rows.select(column).distinct().collect()}
    rows.write.insertInto(table, overwrite=True)
    drop_days(spark, table, column, set(days) - held)


def drop_days(spark: SparkSession, table: str, column: str, days: Collection[date]) -> None:
    for day in sorted(days):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = DATE '{day.isoformat()}')")


def batched_rows(spark: SparkSession, table: str, but: str | None = None) -> DataFrame:
    """The rows of a batched table, without those of batch ``but``, whose files are not read."""
    rows = spark.table(table)
    return (rows if but is None else rows.where(F.col(BATCH) != but)).drop(BATCH)


def upsert_rows(existing: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows whose key is not among the updates, and the updates. Update keys
    must be unique."""
    return existing.join(updates.select(*key), key, "left_anti").unionByName(updates)


def publish_version(df: DataFrame, name: str) -> str:
    """Write a new version of a table and point view ``name`` at it.

    A plain parquet table cannot be read and overwritten in one job; readers of the
    view see the old version until the new one is complete. The version before stays for
    them; older ones are dropped. One writer at a time. Returns the table's name.
    """
    spark = df.sparkSession
    version = _new_version(name)
    df.write.format("parquet").saveAsTable(version)
    _show(spark, name, version, "*")
    return version


def _new_version(name: str) -> str:
    return f"{name}__{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"


def _show(spark: SparkSession, name: str, version: str, columns: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {version}")
    for old in versions_of(spark, name)[:-2]:
        spark.sql(f"DROP TABLE {old}")


def versions_of(spark: SparkSession, name: str) -> list[str]:
    """The version tables of view ``name`` (``database.view``), oldest first."""
    database, view = name.rsplit(".", 1)
    tables = [t.tableName for t in spark.sql(f"SHOW TABLES IN {database} LIKE '{view}__*'").collect()]
    return [f"{database}.{t}" for t in sorted(tables) if re.fullmatch(rf"{re.escape(view)}__\d{{20}}_[0-9a-f]{{8}}", t)]


def create_buckets_if_missing(spark: SparkSession, name: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
    """An empty table for ``upsert_buckets``. Like ``publish_version``, ``name`` is a view of the newest version."""
    if not spark.catalog.tableExists(name):
        _publish_buckets(spark, name, schema, -1, buckets)


def upsert_buckets(
    batch: DataFrame, name: str, schema: T.StructType, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> None:
    """As ``merge_parts``, for rows that lie in buckets of the hash of ``key``."""
    buckets = int(_properties(batch.sparkSession, name)["buckets"])
    merge_parts(batch, name, schema, bucket_of(key, buckets), merge)


def merge_parts(
    batch: DataFrame, name: str, schema: T.StructType, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> None:
    """Merge ``batch`` into a table of ``create_buckets_if_missing`` whose rows lie in the parts that ``part`` names.

    The parts of the batch's rows are read, merged by ``merge`` (rows before, batch) and written anew; a new
    version takes all others over from the last one, files and all. So the work follows the parts that a batch
    touches, not the table. Readers see the last version until the new is complete, and keep its files over
    one more. A batch that failed before its version was published counts for nothing and is written over by the
    next, so it can be repeated. One writer at a time.
    """
    spark, properties = batch.sparkSession, _properties(batch.sparkSession, name)
    number = int(properties["number"]) + 1
    merge_batch(conform(batch, schema), _bucket_folder(spark, name), number, BUCKET, part, merge)
    _publish_buckets(spark, name, schema, number, int(properties["buckets"]))


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {versions_of(spark, name)[-1]}").collect()}


def part_table(spark: SparkSession, name: str) -> DataFrame:
    """The newest version with its parts as column ``bucket``: a condition on it leaves other parts unread."""
    return spark.table(versions_of(spark, name)[-1])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def _bucket_folder(spark: SparkSession, name: str) -> str:
    database, view = name.rsplit(".", 1)
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{view}__{BUCKET}s"


def _publish_buckets(spark: SparkSession, name: str, schema: T.StructType, number: int, buckets: int) -> None:
    """A version whose partitions are the folders that batches up to ``number`` wrote last. It owns no files: dropping
    it leaves them to the versions that share them; ``merge_batch`` deletes those that none does."""
    folder, version = _bucket_folder(spark, name), _new_version(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {version} ({columns}, {BUCKET} string) USING parquet PARTITIONED BY ({BUCKET}) "
        f"LOCATION '{folder}' TBLPROPERTIES ('number' = '{number}', 'buckets' = '{buckets}')"
    )
    written = parts(spark, folder, BUCKET, number + 1)
    if written:
        added = [f"PARTITION ({BUCKET} = '{b}') LOCATION '{folder}/batch_id={n[-1]}/{BUCKET}={b}'" for b, n in sorted(written.items())]
        spark.sql(f"ALTER TABLE {version} ADD {' '.join(added)}")
    _show(spark, name, version, ", ".join(f"`{f.name}`" for f in schema.fields))
