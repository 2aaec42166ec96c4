"""The next row of every row along an id, for tables of any size."""

from __future__ import annotations

from itertools import batched
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 4_000
MOST_RANGES = 1 << 14


def range_of(value: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` (ascending) below ``value``; null gives 0. Two steps through
    lists of the square root's length."""
    width = max(1, isqrt(len(bounds)))
    groups = [list(g) for g in batched(bounds, width)]
    if not groups:
        return F.lit(0)
    coarse = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda b: b < value))
    fine = F.element_at(F.lit([*map(list, groups), [groups[-1][-1]]]), coarse + 1) if len(groups) > 1 else F.lit(groups[0])
    within = F.when(coarse < len(groups), F.size(F.filter(fine, lambda b: b < value))).otherwise(0)
    return F.when(value.isNull(), 0).otherwise(F.least(coarse * width + within, F.lit(len(bounds))))


def with_next(rows: DataFrame, key: str, payload: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, Window]:
    """Ranges of ``rows`` along ``key`` descending (nulls last; ties by ``payload``), in which each
    row's next one, the first after the last, is at lead 1 of the returned window. Rows
    with ``_borrowed`` true are there for their neighbours only and must go afterwards.

    Range bounds are quantiles, at most MOST_RANGES numbers. Each range borrows the largest
    key of the range below, and the lowest one that of the table: one shuffle, no range
    larger than its share, whatever the keys.
    """
    n = rows.count()
    ranges = min(max(1, -(-n // rows_per_range)), MOST_RANGES)
    quantiles = [i / ranges for i in range(1, ranges)]
    bounds = []
    if quantiles:
        found = rows.select(F.percentile_approx(key, F.lit(quantiles), 4 * MOST_RANGES).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    placed = rows.withColumn("_range", range_of(F.col(key), bounds))
    tops = dict(placed.groupBy("_range").agg(F.max(key)).collect())  # a number per range
    present = sorted(tops)
    top = max((t for t in tops.values() if t is not None), default=None)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("late"), F.lit(False).alias("borrowed"))

    def lent(to: Column, late: int) -> Column:
        return F.struct(to.alias("range"), F.lit(late).alias("late"), F.lit(True).alias("borrowed"))

    to_upper = range_lent(F.col(key), F.col("_range"), present, tops)
    wrap = F.when(F.col(key).eqNullSafe(F.lit(top)), lent(F.lit(present[0] if present else 0), 2))
    copies = F.filter(F.array(own, F.when(to_upper.isNotNull(), lent(to_upper, 1)), wrap), lambda c: c.isNotNull())
    dealt = placed.select(*rows.columns, F.explode(copies).alias("_copy")).select(
        *rows.columns, F.col("_copy.range").alias("_range"), F.col("_copy.late").alias("_late"), F.col("_copy.borrowed").alias("_borrowed")
    )
    order = Window.partitionBy("_range").orderBy("_late", F.col(key).desc_nulls_last(), payload)
    return dealt, order


def range_lent(key: Column, own: Column, present: list[int], tops: dict[int, int | None]) -> Column:
    """The range above, for the largest key of a range; else null."""
    size = (max(present) if present else 0) + 1
    above = dict(zip(present, present[1:]))
    top = F.element_at(F.lit([tops.get(i) if tops.get(i) is not None else 0 for i in range(size)]), own + 1)
    up = F.element_at(F.lit([above.get(i, -1) for i in range(size)]), own + 1)
    is_top = (key == top) | (key.isNull() & F.lit(any(v is None for v in tops.values())))
    return F.when(is_top & (up >= 0), up)
