"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(
    app: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session for tests, benchmarks and scripts. On a cluster, leave ``master``
    and ``shuffle_partitions`` unset: the submit command and AQE decide."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. The cluster names it in
    ``spark.checkpoint.dir``; only where that is unset (a local test) is a
    temporary one made."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return _local_dir(context.applicationId).name


@cache
def _local_dir(application: str) -> tempfile.TemporaryDirectory:
    """Kept while the process runs and deleted when it ends."""
    return tempfile.TemporaryDirectory(prefix=f"meterwise-{application}-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never reused, so a retry cannot mix runs. All
    paths of one application lie in one folder; ``scratch_cleared`` deletes it."""
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/meterwise/{spark.sparkContext.applicationId}"


@contextmanager
def scratch_cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the application's scratch folder at the end of the block, whose results
    must have been written elsewhere by then: for a scheduled application that lives long."""
    try:
        yield
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _settled.clear()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a durable copy, so several consumers share one
    evaluation, a lost executor does not repeat it, and the optimizer sees the
    true size of the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_settled: dict[tuple[str, ...], tuple[str, StructType]] = {}


def settle_once(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """As ``settle``, but one copy serves the application: for what is derived from a
    ``source`` that does not change while it runs."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), label, source)
    if key not in _settled:
        df, path = make(), scratch_path(spark, label)
        df.write.parquet(path)
        _settled[key] = path, df.schema
    path, schema = _settled[key]
    return spark.read.schema(schema).parquet(path)
