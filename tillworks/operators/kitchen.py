"""Kitchen boards, lanes and status histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import timeutil as T
from tillworks.operators.prefix import previous_value

LANES = {"new": "queued", "preparing": "preparing", "ready": "ready"}
STEPS = ("new", "preparing", "ready", "served")


def not_cancelled() -> Column:
    return F.col("payment_status") != "cancelled"


def since(as_of, hours: int, column: str = "created_at") -> Column:
    return F.col(column) > T.instant(as_of) - F.expr(f"interval {hours} hours")


def open_orders(orders: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Bills the public board shows: not cancelled, not served, from the last hours."""
    return orders.filter(F.col("kitchen_status").isin(*LANES) & not_cancelled() & since(as_of, hours))


def lane_top_n(orders: DataFrame, n: int = 12) -> DataFrame:
    """First ``n`` bills of each lane: oldest first while cooking, newest change first when ready.

    Spark cuts every map task to ``n`` rows per lane before the shuffle.
    """
    ready = F.col("kitchen_status") == "ready"
    age = F.when(~ready, T.micros(F.col("created_at"))).otherwise(-T.micros(F.col("kitchen_updated_at")))
    rows = orders.withColumn("_key", age)
    w = Window.partitionBy("kitchen_status").orderBy(F.asc_nulls_last("_key"), "id")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).drop("_key").withColumn("lane", lane(F.col("kitchen_status")))


def lane(status: Column) -> Column:
    out = F.when(status == "new", F.lit(LANES["new"]))
    for s in ("preparing", "ready"):
        out = out.when(status == s, F.lit(LANES[s]))
    return out


def today_counters(orders: DataFrame, as_of) -> DataFrame:
    """Bills since local midnight, and those already served."""
    today = T.DayRange.resolve(as_of=as_of)
    rows = orders.filter(not_cancelled() & (F.col("created_at") >= T.instant(today.start)))
    return rows.agg(F.count("*").alias("orders_today"), F.count_if(F.col("kitchen_status") == "served").alias("served_today"))


def active_queue(orders: DataFrame, as_of, hours: int = 24, n: int = 100) -> DataFrame:
    rows = orders.filter((F.col("kitchen_status") != "served") & not_cancelled() & since(as_of, hours))
    return rows.orderBy("created_at", "id").limit(n)


def served_lately(orders: DataFrame, as_of, hours: int = 2, n: int = 10) -> DataFrame:
    rows = orders.filter((F.col("kitchen_status") == "served") & not_cancelled() & since(as_of, hours, "kitchen_updated_at"))
    return rows.orderBy(F.desc_nulls_last("kitchen_updated_at"), F.desc("id")).limit(n)


def kitchen_queue(orders: DataFrame, as_of) -> DataFrame:
    """Active queue and the last served bills, marked by ``board``."""
    active = active_queue(orders, as_of).withColumn("board", F.lit("active"))
    return active.unionByName(served_lately(orders, as_of).withColumn("board", F.lit("served")))


def lane_counts(orders: DataFrame) -> DataFrame:
    """Bills per lane plus ``cooking``: queued and preparing together."""
    lanes = orders.withColumn("lane", lane(F.col("kitchen_status"))).filter("lane is not null")
    both = F.when(F.col("lane") != "ready", F.array("lane", F.lit("cooking"))).otherwise(F.array("lane"))
    return lanes.select(F.explode(both).alias("lane")).groupBy("lane").agg(F.count("*").alias("orders"))


def status_changes(events: DataFrame, column: str) -> DataFrame:
    """(old, new) pairs of a status per order in time order; repeats of the same status are dropped."""
    rows = events.select("id", "order_id", "created_at", F.col(column).alias("new"))
    rows = previous_value(rows, ["order_id"], ["created_at", "id"], F.floor(T.hour_slot(F.col("created_at")) / 24), "new", "old")
    return rows.filter(F.col("old").isNotNull() & (F.col("old") != F.col("new"))).select("id", "order_id", "old", "new", "created_at")


def kitchen_transitions(events: DataFrame) -> DataFrame:
    """Kitchen changes flagged as the next step, one step back, or a jump. Cancelled orders change nothing."""
    changes = status_changes(events.filter("payment_status <> 'cancelled'"), "kitchen_status")
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col(c))
    step = place("new") - place("old")
    return changes.withColumn("move", F.when(step == 1, "next").when(step == -1, "back").otherwise("jump"))


def payment_fold(events: DataFrame) -> DataFrame:
    """Final payment status and time per order, from requested changes.

    The paid time is the first payment after the last return to pending; cancelling
    keeps it. Two plain aggregates, both combined map-side, no window.
    """
    at = F.struct("created_at", "id")
    is_paid, is_pending = F.col("payment_status") == "paid", F.col("payment_status") == "pending"
    last = events.groupBy("order_id").agg(
        F.max_by("payment_status", at).alias("payment_status"), F.max(F.when(is_pending, at)).alias("_reset")
    )
    paid = events.filter(is_paid).select("order_id", at.alias("_at")).join(last.select("order_id", "_reset"), "order_id")
    paid = paid.filter(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))).groupBy("order_id").agg(F.min("_at.created_at").alias("paid_at"))
    return last.drop("_reset").join(paid, "order_id", "left")


def new_since_last(now: DataFrame, before: DataFrame) -> DataFrame:
    """Orders whose (id, status) was not on the previous snapshot."""
    return now.join(before.select("id", "kitchen_status"), ["id", "kitchen_status"], "left_anti")


def board_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """The one change worth announcing between two boards (rows with lane and pos):
    first newly ready, else first newly preparing, else first newly queued order."""
    fresh = now.join(before.select("id", "lane"), ["id", "lane"], "left_anti")
    urgency = F.when(F.col("lane") == "ready", 1).when(F.col("lane") == "preparing", 2).otherwise(3)
    text = (
        F.when(F.col("lane") == "ready", F.concat(F.lit("Order #"), F.col("id").cast("string"), F.lit(" is ready")))
        .when(F.col("lane") == "preparing", F.concat(F.lit("Order #"), F.col("id").cast("string"), F.lit(" is being prepared")))
        .otherwise(F.concat(F.lit("New order #"), F.col("id").cast("string")))
    )
    return fresh.orderBy(urgency, "pos").limit(1).select("id", "lane", text.alias("text"))


def board_summary(board: DataFrame, counters: DataFrame) -> DataFrame:
    """The line shown when there is no earlier board to compare with."""
    facts = board.agg(
        F.max_by("id", F.when(F.col("lane") == "preparing", F.col("pos"))).alias("cooking"),
        F.count_if(F.col("lane") == "queued").alias("queued"),
        F.min_by("id", F.when(F.col("lane") == "ready", F.col("pos"))).alias("ready"),
        F.lit(1).alias("_k"),
    )
    rows = facts.join(counters.withColumn("_k", F.lit(1)), "_k")
    text = (
        F.when(F.col("cooking").isNotNull(), F.concat(F.lit("Order #"), F.col("cooking").cast("string"), F.lit(" is being prepared")))
        .when(F.col("queued") > 0, F.concat(F.col("queued").cast("string"), F.lit(" waiting")))
        .when(F.col("ready").isNotNull(), F.concat(F.lit("Order #"), F.col("ready").cast("string"), F.lit(" is ready")))
        .when(F.col("orders_today") > 0, F.concat(F.col("orders_today").cast("string"), F.lit(" served up today")))
        .otherwise(F.lit("No orders yet today"))
    )
    return rows.select(text.alias("text"))
