"""Token-ID output: Parquet files of documents and their ids, and selective reads of them.

File format. One row per document, ascending by ``doc_id`` (nulls first) across the
files: ``row`` (file order), ``doc_id``, ``n_tokens``, ``ids`` (list of int). ``ids`` and
``row`` are delta-encoded, without a dictionary; small row groups and pages with column
and offset indexes let a reader fetch metadata without ids, and the ids of a range of
``doc_id`` without the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterwise.llm.tokens import ids_crc32, token_ids

FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",  # its encoding of whole numbers is delta
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "64",
    "compression": "zstd",
}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None) -> None:
    """Encode ``docs`` (``doc_id``, ``text``; null text: empty) and write the files to ``path``.

    One range shuffle orders the texts; it spreads rows by sampled ids, so no source or
    long text decides a task's share. Rows of one ``doc_id`` are ordered by their text and
    each gets a row. An empty table gives no rows. Further columns are left out.
    """
    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    )
    encoded = ordered.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", token_ids(vocabulary, end_id)(F.col("text")).alias("ids")
    )
    encoded.select("row", "doc_id", F.size("ids").alias("n_tokens"), "ids").write.options(**FILE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The files' rows; a condition on ``doc_id`` or ``n_tokens`` skips row groups and
    pages, and only the named columns are read."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before it. A running sum within each file,
    carried on by one total per file."""
    files = rows.withColumn("_file", F.shiftrightunsigned("row", 33))
    totals = files.groupBy("_file").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    within = Window.partitionBy("_file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(carried, "_file").withColumn("start", F.col("_carried") + F.col("_inside")).drop("_file", "_inside", "_carried")


def token_digest(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of the rows of token files. The ids
    leave the rows before these are ordered."""
    slim = rows.select("row", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    return with_starts(slim).select("doc_id", "start", "n_tokens", "ids_crc32")
