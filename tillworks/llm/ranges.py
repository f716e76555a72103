"""Ordered work over one integer column without a task that holds it all: balanced range buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 512  # cells of the histogram that is read to the driver


def buckets(df: DataFrame, name: str, rows: int = 4096) -> Column:
    """Expression that numbers ranges of column ``name`` in its order, of about ``rows`` rows each.

    A histogram of ``CELLS`` equal cells (the only thing the driver sees) gives each cell as many
    buckets as its rows ask for, so clustered values are dealt evenly too. Null goes to bucket -1.
    """
    c = F.col(name).cast("decimal(38,0)")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return F.lit(-1).cast("long")
    width = (int(high) - int(low)) // CELLS + 1
    at = F.floor((F.col(name).cast("decimal(20,0)") - F.lit(int(low)).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
    counts = {r["cell"]: r["count"] for r in df.where(F.col(name).isNotNull()).groupBy(at.alias("cell")).count().collect()}
    firsts, parts, total = [], [], 0
    for cell in range(CELLS):
        n = max(1, -(-counts.get(cell, 0) // rows))
        firsts.append(total)
        parts.append(max(1, -(-width // n)))
        total += n
    first = F.element_at(F.lit(firsts), at + 1).cast("long")
    part = F.element_at(F.lit(parts), at + 1).cast("decimal(20,0)")
    inner = F.floor(F.pmod(F.col(name).cast("decimal(20,0)") - F.lit(int(low)).cast("decimal(20,0)"), F.lit(width).cast("decimal(20,0)")) / part).cast("long")
    return F.coalesce(first + inner, F.lit(-1).cast("long"))
