"""State of a stream in parts: hours, days, or buckets of a key's hash.

A micro-batch merges its rows into the parts that it touches and writes these anew,
``batch_id=7/hour=2024-01-31-05``; all others stay as they are. Of a part the folder of the newest complete
batch counts, so a reader meets one folder for each part, however many batches there were.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from meterwise.session import settle


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files at ``path``: a folder, or a pattern of files or
    folders (a single file is accepted as a pattern only)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# Folders of a part that stay besides the one being written: the newest, and the one that a reader may still hold.
KEPT = 2


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process what is available now, one micro-batch after the other."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, replaced if the batch is repeated after a failure."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def parts(spark: SparkSession, path: str, name: str, before: int | None = None) -> dict[str, list[int]]:
    """The batches, ascending, that wrote each part; only complete ones, and those before batch ``before``. The
    list grows with the parts, which are hours, days or buckets, and not with the batches: see ``merge_batch``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(pattern: str) -> list[list[str]]:
        return [str(status.getPath()).split("/")[-2:] for status in files.globStatus(folder(f"{path}/batch_id=*/{pattern}")) or []]

    number = lambda batch: int(batch.removeprefix("batch_id="))
    complete = {number(batch) for batch, _ in found("_SUCCESS")}
    written: dict[str, list[int]] = defaultdict(list)
    for batch, part in found(f"{name}=*"):
        if number(batch) in complete and (before is None or number(batch) < before):
            written[part.removeprefix(f"{name}=")].append(number(batch))
    return {part: sorted(batches) for part, batches in written.items()}


def newest(
    spark: SparkSession, path: str, schema: T.StructType, name: str, before: int | None = None, only: Collection[str] | None = None
) -> DataFrame:
    """The rows of all parts, or of those in ``only``, as the newest batch left them, or the newest before ``before``.
    Folders of other parts are not read."""
    written = parts(spark, path, name, before)
    chosen = [f"{path}/batch_id={b[-1]}/{name}={part}" for part, b in sorted(written.items()) if only is None or part in only]
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def merge_batch(
    rows: DataFrame, path: str, batch_id: int, name: str, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> None:
    """Write the parts that ``rows`` touch as ``merge`` (rows before, rows) makes them. ``part`` gives a row's part, a
    text without slashes, and must give merged rows the part of their origins.

    A repeated batch merges with the state before it and replaces its own folder. Folders that KEPT newer
    complete ones have superseded are deleted, so the state stays within a few times its size.
    """
    spark, schema = rows.sparkSession, rows.schema
    rows = settle(rows, "batch")
    touched = {r[0] for r in rows.select(part).distinct().collect()}
    merged = merge(newest(spark, path, schema, name, batch_id, touched), rows)
    merged.withColumn(name, part).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(f"{path}/batch_id={batch_id}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = parts(spark, path, name, batch_id)
    for value in touched & set(written):
        for old in written[value][:-KEPT]:
            files.delete(folder(f"{path}/batch_id={old}/{name}={value}"), True)
