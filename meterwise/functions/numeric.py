from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums and means of doubles differ in their last bits with the order in which
# partitions arrive; the nudge, away from zero and no less than some of those bits, keeps a
# value at a rounding tie from tipping.
TIE_NUDGE = 1e-9
RELATIVE_NUDGE = 1e-13


def steady_round(value: Column, places: int) -> Column:
    nudge = F.greatest(F.lit(TIE_NUDGE), F.abs(value) * F.lit(RELATIVE_NUDGE))
    return F.round(value + F.signum(value) * nudge, places)


def whole_number(value: Column) -> Column:
    """Rounded half up to a long, for text."""
    return F.floor(value + F.lit(0.5 + TIE_NUDGE)).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null rather than an error where the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def or_default(value: Column, default: Column) -> Column:
    """The default replaces both null and 0."""
    return F.when(value.isNull() | (value == 0), default).otherwise(value)


def text_or(value: Column, default: Column) -> Column:
    """The default replaces both null and the empty string."""
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def plain_text(value: Column) -> Column:
    """A money amount as text without an exponent and with one or two decimals."""
    return F.regexp_replace(value.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
