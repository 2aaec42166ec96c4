"""Hourly utilisation from node hours of micro-batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.operators.features import merge_node_hours, node_hours, summed_node_hours
from meterwise.streaming.common import merge_batch, newest, parts, run_batches

PARTIAL = (
    T.StructType()
    .add("cluster_id", "string").add("workspace_id", "string").add("hour_window", "timestamp")
    .add("instance_id", "long").add("node_type", "string")
    .add("cpu_sum", "double").add("cpu_n", "long").add("cpu_max", "double")
    .add("mem_sum", "double").add("mem_n", "long").add("mem_max", "double")
)


def refresh(samples: DataFrame, path: str, checkpoint: str) -> None:
    """Reduce each micro-batch to node hours and merge them into the hours that it touches. No watermark: sums,
    maxima and distinct nodes of an hour merge however late its samples come."""

    hour = F.coalesce(F.date_format("hour_window", "yyyy-MM-dd-HH"), F.lit("none"))

    def reduce_batch(batch: DataFrame, batch_id: int) -> None:
        rows = node_hours(batch, F.date_trunc("hour", "start_time"))
        merge_batch(rows, path, batch_id, "hour", hour, lambda before, new: summed_node_hours(before.unionByName(new)))

    run_batches(samples, checkpoint, reduce_batch)


def hourly_from(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Cluster hours of all samples so far, with exact distinct counts: all hours, or those that begin at ``since`` or
    later and before ``until`` (in the session's time zone). One folder an hour is read, whatever the number of batches."""
    written = parts(spark, path, "hour")
    low, high = (moment and f"{moment:%Y-%m-%d-%H}" for moment in (since, until))
    # A bound within an hour leaves out the hour that holds it below, and keeps it above.
    begun = since is not None and (since.minute, since.second, since.microsecond) != (0, 0, 0)
    split = until is not None and (until.minute, until.second, until.microsecond) != (0, 0, 0)
    bounded = since is not None or until is not None
    only = [
        hour for hour in written
        if not (bounded and hour == "none")
        and (low is None or hour > low or (hour == low and not begun))
        and (high is None or hour < high or (hour == high and split))
    ]
    return merge_node_hours(newest(spark, path, PARTIAL, "hour", only=only))
