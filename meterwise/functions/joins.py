"""Join helpers whose strategy depends on a measured size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import Config

# Slots that an open version is repeated for at most.
MOST_SLOTS = 4_096


def holds_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_few(df: DataFrame, cfg: Config) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small; else the optimizer
    decides by its size."""
    return F.broadcast(df) if holds_at_most(df, cfg.broadcast_rows) else df


def join_in_force(
    facts: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, start: str, end: str, cfg: Config
) -> DataFrame:
    """Inner join of each fact to the version in force at ``at``: equal keys and
    ``start <= at < end``, with a null ``end`` read as open.

    Versions are broadcast only if a count shows that they are few; the facts then
    never move. Beyond that, see ``met_in_slots``.
    """
    in_force = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if holds_at_most(versions, cfg.broadcast_rows):
        met = facts.join(F.broadcast(versions), list(keys))
    else:
        met = met_in_slots(facts, versions, keys, at, start, end, cfg)
    return met.where(in_force).drop(start, end)


def met_in_slots(
    facts: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, start: str, end: str, cfg: Config
) -> DataFrame:
    """Each fact with the versions of its key that are in force at some time of the fact's time slot, so that a long
    history does not multiply the facts: a fact meets the version in force and those that change within its slot.

    A version is repeated for the slots it covers between the first and the last fact, which one aggregate over the
    column ``at`` finds; an open end reaches to the last. Keys are few against the facts (a price list has hundreds of products) and
    a slot may be as popular as a key, so facts are also spread over ``salt_buckets`` slices by a hash of the row, and a
    version's slots are repeated for each.
    """
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    earliest, latest = facts.agg(F.min(seconds), F.max(seconds)).first()
    if earliest is None:
        return facts.join(versions.limit(0), list(keys))
    # A fact with an absurd time makes slots wider, not more.
    width = max(cfg.version_slot_hours * 3600, -(-(latest - earliest) // MOST_SLOTS))

    def slot(time: Column) -> Column:
        return F.floor((F.unix_seconds(time.cast("timestamp")) - earliest) / width)

    final = F.lit((latest - earliest) // width).cast("long")
    first = F.greatest(slot(F.col(start)), F.lit(0).cast("long"))
    last = F.least(F.coalesce(slot(F.col(end)), final), final)
    covered = versions.where(F.col(start).isNotNull()).withColumns({"_first": first, "_last": last}).where("_first <= _last")
    repeated = covered.withColumn("_slot", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    slices = F.sequence(F.lit(0).cast("long"), F.lit(cfg.salt_buckets - 1).cast("long"))
    slice_of_row = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(cfg.salt_buckets))
    spread = facts.withColumns({"_slot": slot(F.col(at)), "_slice": slice_of_row})
    return spread.join(repeated.withColumn("_slice", F.explode(slices)), [*keys, "_slot", "_slice"]).drop("_slot", "_slice")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other. ``right`` adds its other columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    meets = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, meets, how).drop(*[f"_right_{k}" for k in keys])
