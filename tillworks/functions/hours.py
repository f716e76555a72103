"""Opening hours: canonical form and open / closed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions import messages
from tillworks.functions.access import minute_of
from tillworks.functions.clean import TIME_PATTERN

WEEK = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
HOURS_MAP = "map<string,struct<closed:boolean,open:string,close:string>>"


def week_entries(shops: DataFrame) -> DataFrame:
    """Per shop the week as seven day entries in weekday order, and the first fault found.

    A missing day, or one marked closed, is closed. No shuffle: all of a shop's
    days come from its own row.
    """
    parsed = shops.select("shop_id", F.from_json("opening_hours", HOURS_MAP).alias("h"))

    def entry(day: str) -> Column:
        e = F.col("h")[day]
        shut = e.isNull() | F.coalesce(e["closed"], F.lit(False))
        badly = ~F.coalesce(e["open"].rlike(TIME_PATTERN) & e["close"].rlike(TIME_PATTERN), F.lit(False))
        fault = (
            F.when(shut, F.lit(None))
            .when(badly, F.lit(messages.missing_times(day.title())))
            .when(e["open"] == e["close"], F.lit(messages.equal_times(day.title())))
        )
        return F.struct(
            F.lit(WEEK.index(day)).alias("weekday"),
            F.lit(day).alias("day"),
            shut.alias("closed"),
            F.when(~shut, e["open"]).alias("open"),
            F.when(~shut, e["close"]).alias("close"),
            fault.alias("fault"),
        )

    days = parsed.filter("h is not null").select("shop_id", F.array(*[entry(d) for d in WEEK]).alias("days"))
    return days.withColumn("error", F.get(F.array_compact(F.transform("days", lambda d: d["fault"])), F.lit(0)))


def normalise_hours(shops: DataFrame) -> DataFrame:
    """One row per shop and weekday; ``error`` is set on all days of a rejected shop."""
    return week_entries(shops).select("shop_id", "error", F.inline("days")).drop("fault")


def valid_week(shops: DataFrame) -> DataFrame:
    """Accepted shops with ``week``: per weekday whether closed, and both times as minutes of the day.

    The test for faults runs inside a generator: as an ordinary filter it would be
    pushed below the parsing step and repeat the parse for every field it looks at.
    """
    minute = lambda c: F.coalesce(minute_of(c), F.lit(0))
    row = F.array(F.struct("error", "days"))
    kept = week_entries(shops).select("shop_id", F.inline(F.filter(row, lambda r: r["error"].isNull())))
    return kept.select(
        "shop_id",
        F.transform("days", lambda d: F.struct(d["closed"].alias("closed"), minute(d["open"]).alias("o"), minute(d["close"]).alias("c"))).alias("week"),
    )


def open_state(moments: DataFrame) -> DataFrame:
    """Adds ``is_open`` and, when closed, ``opens_in_days`` and ``opens_at`` (minute of day).

    Rows carry ``week`` (from :func:`valid_week`), ``weekday`` (0 is Monday) and the
    local ``minute``. Yesterday's hours count while they run past midnight.
    """
    at = lambda shift: F.col("week")[(F.col("weekday") + shift) % 7]
    today, yesterday, minute = at(0), at(6), F.col("minute")
    spill = ~yesterday["closed"] & (yesterday["c"] < yesterday["o"]) & (minute < yesterday["c"])
    started = minute >= today["o"]
    inside = ~today["closed"] & started & ((today["c"] < today["o"]) | (minute < today["c"]))
    ahead = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: ~F.col("week")[((F.col("weekday") + i) % 7).cast("int")]["closed"])
    later_today = ~today["closed"] & ~started
    wait = F.when(later_today, F.lit(0)).otherwise(F.get(ahead, F.lit(0)))
    return (
        moments.withColumn("is_open", spill | inside)
        .withColumn("opens_in_days", F.when(~F.col("is_open"), wait))
        .withColumn("opens_at", F.when(~F.col("is_open"), F.col("week")[((F.col("weekday") + wait) % 7).cast("int")]["o"]))
    )
