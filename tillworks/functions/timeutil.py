"""Local calendar helpers.

Instants are ``timestamp_ntz`` columns holding UTC, so no result depends on the
session time zone. Days and hours are reported in the shop's zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions import messages

SHOP_TZ = "Asia/Kolkata"
MAX_SPAN_DAYS = 366
MINUTE_US = 60_000_000


def instant(value: datetime | str) -> Column:
    """Literal UTC instant; folds to a constant, so scans can push it down."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def local_ts(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(SHOP_TZ), ts)


def local_day(ts: Column) -> Column:
    return F.to_date(local_ts(ts))


def local_hour(ts: Column) -> Column:
    return F.hour(local_ts(ts))


def local_minute(ts: Column) -> Column:
    """Minutes since local midnight."""
    return F.hour(local_ts(ts)) * 60 + F.minute(local_ts(ts))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", instant("1970-01-01"), ts)


def hour_slot(ts: Column) -> Column:
    """Hours since the epoch: a monotone bucket for two-level running totals."""
    return F.timestamp_diff("HOUR", instant("1970-01-01"), ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, never negative."""
    return F.greatest(F.floor(F.timestamp_diff("MICROSECOND", start, end) / MINUTE_US), F.lit(0)).cast("bigint")


def as_day(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def shop_date(as_of: datetime) -> date:
    """The local calendar day of a UTC instant (driver side)."""
    return as_of.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(SHOP_TZ)).date()


@dataclass(frozen=True)
class DayRange:
    """An inclusive range of local days and its half-open range of instants."""

    first: date
    last: date

    @classmethod
    def resolve(cls, first=None, last=None, as_of: datetime | None = None, max_span: int | None = MAX_SPAN_DAYS) -> "DayRange":
        """Missing ``first`` means today, missing ``last`` means ``first``.

        ``max_span=None`` lifts the one-year check for cluster-sized reports.
        """
        if first is None:
            if as_of is None:
                raise ValueError("as_of is needed when the first day is not given")
            first = shop_date(as_of)
        first = as_day(first)
        last = first if last is None else as_day(last)
        if last < first:
            raise ValueError(messages.BAD_RANGE)
        if max_span is not None and (last - first).days > max_span:
            raise ValueError(messages.LONG_RANGE)
        return cls(first, last)

    @property
    def start(self) -> datetime:
        return self._midnight(self.first)

    @property
    def end(self) -> datetime:
        return self._midnight(self.last + timedelta(days=1))

    @staticmethod
    def _midnight(day: date) -> datetime:
        local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(SHOP_TZ))
        return local.astimezone(timezone.utc).replace(tzinfo=None)

    def contains(self, ts: Column) -> Column:
        """Compare the raw instant with literals, so the filter reaches the scan."""
        return (ts >= instant(self.start)) & (ts < instant(self.end))

    def days(self, spark: SparkSession) -> DataFrame:
        """One row per local day of the range."""
        n = (self.last - self.first).days + 1
        return spark.range(n).select(F.date_add(F.lit(self.first), F.col("id").cast("int")).alias("day"))


def preset_ranges(as_of: datetime) -> dict[str, DayRange]:
    """The report shortcuts: today, yesterday, last 7 / 30 days, month to date."""
    today = shop_date(as_of)
    back = lambda n: today - timedelta(days=n)
    return {
        "today": DayRange(today, today),
        "yesterday": DayRange(back(1), back(1)),
        "7": DayRange(back(6), today),
        "30": DayRange(back(29), today),
        "month": DayRange(today.replace(day=1), today),
    }
