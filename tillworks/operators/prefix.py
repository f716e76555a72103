"""Two-level running computations.

A plain ``OVER (PARTITION BY key ORDER BY ...)`` puts every row of a key into one
task. These helpers split each key into ordered slots (for example hours), run
the window per (key, slot), reduce every slot to one summary row, run the small
window over the summaries, and add the carried-in value back. A key holding a
third of all rows is then spread over its slots, and the result is the same.

``slot`` must be monotone in ``order``: rows of a smaller slot come first.
Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table

_SLOT = "_slot"


def _within(keys: list[str], order: list) -> tuple:
    w = Window.partitionBy(*keys, _SLOT).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)


def _over_slots(keys: list[str]):
    w = Window.partitionBy(*keys).orderBy(_SLOT)
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], order: list, slot: Column, **sums: Column) -> DataFrame:
    """Adds inclusive running sums (``name=expression``) per key in ``order``."""
    slotted = df.withColumn(_SLOT, slot)
    upto, _ = _within(keys, order)
    _, _, earlier = _over_slots(keys)
    local = slotted.select("*", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()])
    totals = slotted.groupBy(*keys, _SLOT).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    carried = totals.select(*keys, _SLOT, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums])
    joined = local.join(carried, [*keys, _SLOT])
    base = [F.col(c) for c in df.columns if c not in sums]
    return joined.select(*base, *[(F.coalesce(F.col(n), F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in sums])


def previous_value(df: DataFrame, keys: list[str], order: list, slot: Column, value: str, name: str) -> DataFrame:
    """Adds ``name``: the ``value`` of the key's preceding row, null on its first row."""
    slotted = df.withColumn(_SLOT, slot)
    w = Window.partitionBy(*keys, _SLOT).orderBy(*order)
    by_slot, _, _ = _over_slots(keys)
    local = slotted.select("*", F.lag(value).over(w).alias("_lag"), (F.row_number().over(w) == 1).alias("_first"))
    closing = slotted.groupBy(*keys, _SLOT).agg(F.max_by(value, F.struct(*order)).alias("_close"))
    carried = closing.select(*keys, _SLOT, F.lag("_close").over(by_slot).alias("_carry"))
    joined = local.join(carried, [*keys, _SLOT])
    return joined.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")).alias(name))


def running_balance(df: DataFrame, keys: list[str], order: list, slot: Column, change: Column, reset: Column, opening: DataFrame) -> DataFrame:
    """Running balance with absolute resets.

    ``change`` is a row's signed amount, ``reset`` its absolute new balance (null
    for ordinary rows). ``opening`` has the keys and an ``opening`` column; keys
    without an opening row start at zero. Adds ``before`` and ``after``.
    """
    rows = df.withColumn(_SLOT, slot).withColumn("_set", reset).withColumn("_chg", F.when(reset.isNull(), change).otherwise(F.lit(0)))
    upto, before = _within(keys, order)
    local = rows.withColumn("_cum", F.sum("_chg").over(upto))
    marked = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_cum").alias("at")))
    local = local.withColumn("_base", F.last(marked, ignorenulls=True).over(upto)).withColumn(
        "_base_prev", F.last(marked, ignorenulls=True).over(before)
    )
    # A slot closes either on an absolute value (it saw a reset) or on a net change.
    closing = local.groupBy(*keys, _SLOT).agg(F.max_by(F.struct("_base", "_cum"), F.struct(*order)).alias("_end"))
    slots = closing.select(
        *keys,
        _SLOT,
        F.when(F.col("_end._base").isNotNull(), F.col("_end._base.v") + F.col("_end._cum") - F.col("_end._base.at")).alias("_set"),
        F.when(F.col("_end._base").isNull(), F.col("_end._cum")).otherwise(F.lit(0)).alias("_chg"),
    )
    _, slot_upto, _ = _over_slots(keys)
    by_slot, _, _ = _over_slots(keys)
    slots = slots.withColumn("_cum", F.sum("_chg").over(slot_upto))
    slot_mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_cum").alias("at")))
    slots = slots.withColumn("_base", F.last(slot_mark, ignorenulls=True).over(slot_upto)).join(opening.select(*keys, "opening"), keys, "left")
    start = F.coalesce(F.col("opening"), F.lit(0))
    slots = slots.withColumn("_bal", _resolve(F.col("_base"), start, F.col("_cum")))
    carried = slots.select(*keys, _SLOT, F.lag("_bal").over(by_slot).alias("_prev"), start.alias("_start"))
    carried = carried.select(*keys, _SLOT, F.coalesce("_prev", "_start").alias("_carry"))
    out = local.join(carried, [*keys, _SLOT])
    return out.select(
        *df.columns,
        _resolve(F.col("_base_prev"), F.col("_carry"), F.col("_cum") - F.col("_chg")).alias("before"),
        _resolve(F.col("_base"), F.col("_carry"), F.col("_cum")).alias("after"),
    )


def _resolve(base: Column, carry: Column, cum: Column) -> Column:
    """Balance from the last reset in the slot, else from the carried-in balance."""
    return F.when(base.isNotNull(), base["v"] + cum - base["at"]).otherwise(carry + cum)


def running_last(df: DataFrame, keys: list[str], order: list, slot: Column, value: str, name: str) -> DataFrame:
    """Adds ``name``: the latest non-null ``value`` of the key up to and including the row."""
    slotted = df.withColumn(_SLOT, slot)
    upto, _ = _within(keys, order)
    local = slotted.withColumn("_last", F.last(value, ignorenulls=True).over(upto))
    closing = slotted.filter(F.col(value).isNotNull()).groupBy(*keys, _SLOT).agg(F.max_by(value, F.struct(*order)).alias("_close"))
    # Slots without any value carry nothing of their own but still need the carried-in one.
    slots = slotted.groupBy(*keys, _SLOT).agg(F.count("*").alias("_n")).join(closing, [*keys, _SLOT], "left")
    _, _, earlier = _over_slots(keys)
    carried = slots.select(*keys, _SLOT, F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
    joined = local.join(carried, [*keys, _SLOT])
    return joined.select(*df.columns, F.coalesce("_last", "_carry").alias(name))


def latest_before(df: DataFrame, keys: list[str], order: list, slot: Column, **marks: Column) -> DataFrame:
    """Adds per ``name=expression`` the key's latest non-null value strictly before the row, null where there is none."""
    slotted = df.select("*", slot.alias(_SLOT), *[e.alias(f"_m_{n}") for n, e in marks.items()])
    _, before = _within(keys, order)
    _, _, earlier = _over_slots(keys)
    local = slotted.select("*", *[F.last(f"_m_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in marks])
    at = F.struct(*order)
    closing = slotted.groupBy(*keys, _SLOT).agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), at)).alias(f"_c_{n}") for n in marks])
    carried = closing.select(*keys, _SLOT, *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in marks])
    joined = local.join(carried, [*keys, _SLOT])
    return joined.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in marks])


def marks_before(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, slot_width: int, name: str) -> tuple[DataFrame, DataFrame]:
    """For sliding windows over hot keys: how many ``marks`` of a key lie strictly before a point.

    ``probes`` and ``marks`` have the keys and ``at``, a whole number; ``probes`` may have more columns. Returns the probes
    with ``name``, the count of marks with a smaller ``at``, and the marks numbered from 1 in the same column. A window
    [from, to) then holds the difference of two probes, whatever its length and however many rows it covers.
    """
    both = probes.withColumn("_mark", F.lit(0)).unionByName(marks.select(*keys, at, F.lit(1).alias("_mark")), allowMissingColumns=True)
    counted = stage_table(running_sum(both, keys, [at, "_mark"], F.floor(F.col(at) / slot_width), **{name: F.col("_mark")}))
    return counted.filter("_mark = 0").drop("_mark"), counted.filter("_mark = 1").select(*keys, at, name)


def numbered_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in ``order`` over the whole table, from 1.

    Rows are dealt by ranges of ``order`` and numbered in their range; a range's offset is
    the sum of the counts before it. The driver sees one count for each range.
    """
    dealt = stage_table(df.repartitionByRange(*order).withColumn(_SLOT, F.spark_partition_id()))
    counts = sorted(dealt.groupBy(_SLOT).count().collect())
    offsets = {slot: sum(n for _, n in counts[:i]) for i, (slot, n) in enumerate(counts)}
    first = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col(_SLOT)] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy(_SLOT).orderBy(*order)) + first
    return dealt.withColumn(name, place).drop(_SLOT)
