"""Run collapse as a stream of partial runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.operators.features import RUN_KEY, collapse_periods
from meterwise.streaming.common import merge_batch, newest, run_batches

PARTIAL = (
    T.StructType()
    .add("workspace_id", "string").add("job_id", "string").add("run_id", "long")
    .add("run_start", "timestamp").add("run_end", "timestamp").add("result_state", "string")
)


def refresh(periods: DataFrame, path: str, checkpoint: str) -> None:
    """Collapse each micro-batch by itself: the minimum, maximum and greatest state of a run merge later. Partial
    runs are kept by the day they start on, and a batch writes its own days anew, not all runs. A run whose
    periods come in batches of several days has a partial row on each of these."""

    day = F.coalesce(F.date_format("run_start", "yyyy-MM-dd"), F.lit("none"))

    def collapse(batch: DataFrame, batch_id: int) -> None:
        merge_batch(collapse_periods(batch), path, batch_id, "day", day, lambda before, new: _merged(before.unionByName(new)))

    run_batches(periods, checkpoint, collapse)


def _merged(partial: DataFrame) -> DataFrame:
    return collapse_periods(partial.withColumnsRenamed({"run_start": "period_start_time", "run_end": "period_end_time"}))


def collapsed_from(spark: SparkSession, path: str) -> DataFrame:
    """All runs so far."""
    return _merged(newest(spark, path, PARTIAL, "day")).select(*RUN_KEY, "run_start", "run_end", "result_state")
