"""Versioned definitions and prices in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import Config
from meterwise.functions.joins import join_in_force
from meterwise.functions.versioning import newest_version

JOB_KEY = ["workspace_id", "job_id"]
CLUSTER_KEY = ["cluster_id", "workspace_id"]


def latest_jobs(jobs: DataFrame) -> DataFrame:
    named = jobs.select(*JOB_KEY, F.col("name").alias("job_name"), "change_time")
    return newest_version(named, JOB_KEY).select(*JOB_KEY, "job_name")


def latest_clusters(clusters: DataFrame) -> DataFrame:
    return newest_version(clusters, CLUSTER_KEY)


def live_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters whose newest version is not deleted."""
    return latest_clusters(clusters).where(F.col("delete_time").isNull())


def last_undeleted_clusters(clusters: DataFrame) -> DataFrame:
    """The newest version that was not a deletion. Unlike ``live_clusters`` this
    still lists a cluster that has since been deleted."""
    return latest_clusters(clusters.where(F.col("delete_time").isNull()))


def priced_usage(usage: DataFrame, prices: DataFrame, cfg: Config) -> DataFrame:
    """Usage with the price in force at its start, and its cost. Usage without a
    price in force drops out."""
    joined = join_in_force(
        usage, prices, ["cloud", "sku_name"], "usage_start_time", "price_start_time", "price_end_time", cfg
    )
    return joined.withColumn("cost_usd", F.col("usage_quantity") * F.col("unit_price"))


def with_job_name(per_job: DataFrame, jobs: DataFrame) -> DataFrame:
    """Left join to the newest job name; a job without a definition keeps a null name."""
    return per_job.join(latest_jobs(jobs), JOB_KEY, "left")
