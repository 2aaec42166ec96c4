"""The feed of changed documents to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions.versioning import newest_version
from meterwise.operators.knowledge import changed_documents, index_state
from meterwise.streaming.common import merge_batch, newest, run_batches, write_batch

STATE = T.StructType().add("doc_id", "string").add("content_hash", "long")
# A state of 10 billion documents (some 300 GB) wants some 65,536. The number must not change while a state is kept.
BUCKETS = 64


def refresh(documents: DataFrame, feed: str, state: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Write the documents of each micro-batch that the index lacks or has with other
    content to ``feed``, and remember their hashes in ``state``. Of several versions in one
    batch the newest by ``updated_at`` counts. A batch reads the buckets of its keys and writes those of changed
    documents. A repeated batch sees the state before it, so it gives the same rows."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("string")

    def replaced(before: DataFrame, fed: DataFrame) -> DataFrame:
        return before.join(fed.select("doc_id"), "doc_id", "left_anti").unionByName(fed)

    def changed(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        batch = newest_version(batch, ["doc_id"], "updated_at")
        rows = changed_documents(batch, newest(spark, state, STATE, "bucket", batch_id, touched))
        write_batch(rows, feed, batch_id)
        written = spark.read.parquet(f"{feed}/batch_id={batch_id}")
        merge_batch(index_state(written), state, batch_id, "bucket", bucket, replaced)

    run_batches(documents, checkpoint, changed)


def feed_from(spark: SparkSession, feed: str) -> DataFrame:
    return spark.read.option("basePath", feed).parquet(feed)
