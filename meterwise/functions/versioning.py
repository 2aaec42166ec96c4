"""Newest-row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    ``row_number`` under a limit is planned with a per-task group limit below the
    shuffle, so a key that holds most of the rows sends only ``n`` rows per task.
    """
    position = rank or "_position"
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(position) <= n)
    return kept if rank else kept.drop(position)


def newest_version(df: DataFrame, keys: Sequence[str], changed: str = "change_time") -> DataFrame:
    """One row per key, the one with the latest ``changed``. The remaining columns
    break ties, so that equal change times give one answer."""
    ties = [F.col(c).desc_nulls_last() for c in df.columns if c != changed and c not in keys]
    return top_per_key(df, keys, [F.col(changed).desc_nulls_last(), *ties])
