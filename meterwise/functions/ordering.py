"""Order-dependent operations on keys of any size.

A plain ``lag`` or ``row_number`` moves a whole key into one task. Both helpers
take a ``bucket``: a column that is a non-decreasing function of the order, such as
the hour of a timestamp. The order-dependent step runs per (key, bucket), and a
partially aggregated summary per bucket carries the state from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.joins import join_null_safe


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Sequence[str], name: str
) -> DataFrame:
    """Add struct ``name`` with the ``value`` columns of the row before; null on the first."""
    keyed = df.withColumn("_bucket", bucket)
    current = F.struct(*value)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tails = keyed.groupBy(*keys, "_bucket").agg(F.max_by(current, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, "_bucket", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    inside = keyed.withColumn("_inside", F.lag(current).over(within))
    return (
        join_null_safe(inside, carried, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", "_bucket")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... along ``order`` within each key."""
    keyed = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = keyed.withColumn("_inside", F.row_number().over(within))
    return (
        join_null_safe(inside, offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1)
        .drop("_inside", "_offset", "_bucket")
    )
