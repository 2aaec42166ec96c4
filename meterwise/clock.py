"""The injected "now". Every bound becomes a literal, so filters on raw columns
fold to constants and can be pushed to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_literal(moment: datetime) -> Column:
    # Via text: a Python datetime literal would be read in the driver's own time
    # zone, while text is read in the session time zone.
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def date_literal(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


@dataclass(frozen=True)
class Clock:
    """``as_of`` stands for the current timestamp, its date for the current date."""

    as_of: datetime

    @property
    def day(self) -> date:
        return self.as_of.date()

    @property
    def now(self) -> Column:
        return timestamp_literal(self.as_of)

    @property
    def today(self) -> Column:
        return date_literal(self.day)

    @property
    def month_start(self) -> Column:
        return date_literal(self.day.replace(day=1))

    @property
    def month_start_ts(self) -> Column:
        return timestamp_literal(datetime.combine(self.day.replace(day=1), datetime.min.time()))

    def date_ago(self, days: int) -> Column:
        return date_literal(self.day - timedelta(days=days))

    def midnight_ago(self, days: int) -> Column:
        """Midnight of the day that lies ``days`` before today."""
        return timestamp_literal(datetime.combine(self.day - timedelta(days=days), datetime.min.time()))

    def hours_ago(self, hours: int) -> Column:
        return timestamp_literal(self.as_of - timedelta(hours=hours))

    def months_ago(self, months: int) -> Column:
        return F.add_months(self.today, -months)

    # Windows are bounded above as well, so that a replay at a past ``as_of``
    # ignores what came later.
    def dates_since(self, column: str, lower: Column) -> Column:
        return (F.col(column) >= lower) & (F.col(column) <= self.today)

    def times_since(self, column: str, lower: Column) -> Column:
        return (F.col(column) >= lower) & (F.col(column) <= self.now)
