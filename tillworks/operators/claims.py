"""Requests decided in time order over shared counters.

A request claims an amount of one or several resources (a use of a coupon, a quantity of an
ingredient) and is accepted only if every claim still fits; a refused one takes nothing, and an
accepted one may give its claims back later. Whether a request fits thus hangs on all earlier
decisions, through any chain of shared resources.

Each round brackets what was in use before a request: at least what accepted requests hold, at most
that plus what undecided ones ask for. A request that fits under the upper figure is accepted,
one that fails under the lower figure is refused. The earliest undecided requests, at most
``PREFIX`` claims of them, are replayed one after the other in the same round, so a round
always decides them: there are no more than ``claims / PREFIX + 1`` rounds, and one replay holds
no more than ``PREFIX`` rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import timeutil as T
from tillworks.operators.prefix import running_sum

PREFIX = 50_000  # claims that one replay holds, at most
HOUR_US = 60 * T.MINUTE_US


def _events(rows: DataFrame) -> DataFrame:
    """Takes and gives of claims in one table; at the same instant what is given back comes first."""
    take = F.struct(F.col("at").alias("time"), F.lit(1).alias("turn"), F.col("need").alias("amount"))
    give = F.struct(F.col("until").alias("time"), F.lit(0).alias("turn"), (-F.col("need")).alias("amount"))
    return rows.select("*", F.inline(F.array(take, give))).filter("time is not null")


def _over_time(events: DataFrame, **sums) -> DataFrame:
    return running_sum(events, ["resource"], ["time", "turn", "bill"], F.floor(F.col("time") / HOUR_US), **sums)


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides a prefix of the undecided requests one by one; stops at one that is not whole."""
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "bill"], kind="stable")
    rows["until"] = rows["until"].astype("Int64").fillna(-(1 << 63))
    at, bill, resource, need, until, capacity, used, parts = (rows[c].tolist() for c in ("at", "bill", "resource", "need", "until", "capacity", "used", "parts"))
    held: defaultdict[str, int] = defaultdict(int)
    back: list[tuple[int, str, int]] = []
    out, i = [], 0
    while i < len(bill) and i + parts[i] <= len(bill):
        own = range(i, i + parts[i])
        while back and back[0][0] <= at[i]:
            _, r, given = heapq.heappop(back)
            held[r] -= given
        fits = all(used[k] + held[resource[k]] + need[k] <= capacity[k] for k in own)
        out.append((bill[i], fits))
        for k in own if fits else ():
            held[resource[k]] += need[k]
            if until[k] > at[k]:
                heapq.heappush(back, (until[k], resource[k], need[k]))
        i += parts[i]
    yield pd.DataFrame(out, columns=["bill", "replayed"]).astype({"bill": "int64", "replayed": "bool"})


def rounds(claims: DataFrame, capacity: DataFrame, changes: DataFrame | None = None, prefix: int = PREFIX) -> Iterator[DataFrame]:
    """The decisions ``(bill, accepted)`` of one round after the other, see :func:`decide`."""
    own = claims.select("bill", "at", "resource", "need", F.when(F.col("until") > F.col("at"), F.col("until")).alias("until"))
    bound = own.join(capacity.select("resource", "capacity"), "resource")
    bound = stage_table(bound.join(bound.groupBy("bill").agg(F.count("*").alias("parts")), "bill"))
    state = ["bill", "at", "resource", "need", "until", "capacity", "parts", "used", "accepted"]
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    rows = bound.select(*state[:7], zero.alias("used"), none.cast("boolean").alias("accepted"))
    if changes is not None:
        # What other requests do is like claims that were accepted before; they have no parts.
        fixed = changes.select(zero.alias("bill"), F.col("time").alias("at"), "resource", F.col("amount").cast("bigint").alias("need"))
        rows = rows.unionByName(fixed.select("*", *[none.cast("bigint").alias(c) for c in ("until", "capacity")], zero.alias("parts"), zero.alias("used"), F.lit(True).alias("accepted")))
    while True:
        open_ = F.col("accepted").isNull()
        events = _events(rows).withColumn("turn", F.when(F.col("parts") == 0, 0).otherwise(F.col("turn")))
        # Requests accepted in the last round ride along once, to be added to what was used.
        summed = _over_time(events, _wait=F.when(open_, F.col("amount")).otherwise(0), _new=F.when(open_, 0).otherwise(F.col("amount")))
        asked = summed.filter(open_ & (F.col("turn") == 1)).withColumn("used", F.col("used") + F.col("_new"))
        tested = stage_table(asked.select(
            *state, (F.col("used") + F.col("_wait") <= F.col("capacity")).alias("_fits"), (F.col("used") + F.col("need") > F.col("capacity")).alias("_short")
        ))
        earliest = tested.orderBy("at", "bill", "resource").limit(prefix).coalesce(1)
        replayed = earliest.select("bill", "at", "resource", "need", "until", "capacity", "used", "parts").mapInPandas(_replay, "bill bigint, replayed boolean")
        bracket = tested.groupBy("bill").agg(F.when(F.bool_or("_short"), False).when(F.bool_and("_fits"), True).alias("bracket"))
        verdicts = bracket.join(replayed, "bill", "left").select("bill", F.coalesce("replayed", "bracket").alias("verdict"))
        rows = stage_table(tested.drop("_fits", "_short", "accepted").join(verdicts, "bill").withColumnRenamed("verdict", "accepted"))
        yield rows.filter("accepted is not null").select("bill", "accepted").distinct()
        if rows.filter("accepted is null").isEmpty():
            return
        rows = rows.filter("accepted is null or accepted")


def decide(claims: DataFrame, capacity: DataFrame, changes: DataFrame | None = None, prefix: int = PREFIX) -> DataFrame:
    """``(bill, accepted)`` for every request with a claim on a resource of known capacity.

    ``claims``: (bill, at, resource, need, until), one row per request and resource; times are
    microseconds, amounts whole units above zero, ``until`` is when an accepted request gives the claim
    back (null: never; not after ``at``: never either). Requests come in the order of ``at`` and
    ``bill``. ``capacity``: (resource, capacity); resources without a row bind nobody.
    ``changes``: (resource, time, amount) of use by requests decided elsewhere.
    """
    out = None
    for found in rounds(claims, capacity, changes, prefix):
        out = found if out is None else out.unionByName(found)
    return out


def accepted_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """The claims of accepted requests."""
    return claims.join(decisions.filter("accepted").select("bill"), "bill", "left_semi").select("bill", "at", "resource", "need", "until")


def used_before(asks: DataFrame, accepted: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``asks`` (bill, at, resource, need, ...) with ``used``: what accepted claims hold of the resource just before.

    ``accepted``: the accepted claims, in the form of :func:`decide`; an ask that is one of them does not count itself.
    """
    extra = [c for c in asks.columns if c not in ("bill", "at", "resource", "need")]
    own = asks.select("bill", F.col("at").alias("time"), F.lit(1).alias("turn"), "resource", F.lit(0).cast("bigint").alias("amount"), F.struct("need", *extra).alias("ask"))
    none = F.lit(None).cast(own.schema["ask"].dataType)
    held = _events(accepted.select("bill", "at", "resource", "need", F.when(F.col("until") > F.col("at"), F.col("until")).alias("until")))
    events = own.unionByName(held.select("bill", "time", F.when(F.col("turn") == 1, 2).otherwise(0).alias("turn"), "resource", "amount", none.alias("ask")))
    if changes is not None:
        events = events.unionByName(changes.select(F.lit(0).cast("bigint").alias("bill"), "time", F.lit(0).alias("turn"), "resource", F.col("amount").cast("bigint"), none.alias("ask")))
    # Within one instant bills follow each other, so an ask sees the earlier bills of its instant.
    events = events.withColumn("order", F.when(F.col("turn") == 0, F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("turn").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("bill").alias("b"), F.col("turn").alias("c"))))
    summed = running_sum(events, ["resource"], ["time", "order"], F.floor(F.col("time") / HOUR_US), used=F.col("amount"))
    return summed.filter("ask is not null").select("bill", F.col("time").alias("at"), "resource", "ask.*", "used")
