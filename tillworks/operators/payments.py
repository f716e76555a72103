"""Payments confirmed and statuses set, request by request and set at once.

A request either confirms a pending bill, with or without another method, or sets a status outright. What a
bill's status is before a request follows from the latest status set and whether a confirmation came since, so
all requests are decided by one look-back that splits a busy bill into time slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import clean, messages
from tillworks.functions import timeutil as T
from tillworks.operators.prefix import latest_before

STATUSES = ("paid", "pending", "cancelled")
METHODS = ("cash", "upi", "card")


def decide(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """``requests`` (id, order_id, kind, value, created_at) with ``old``, ``new``, ``method``, ``total`` and ``error``.

    ``kind`` is ``pay`` (``value``: a method or nothing) or ``status`` (``value``: the status). ``orders`` has id,
    payment_status, payment_method and total. Requests of one instant follow their ids, which are distinct. A bill that
    already has the wanted status is left as it is (``old`` equals ``new``), its method too; a refused request has an
    ``error`` and no ``new``. ``method`` is the bill's method after a confirmation.
    """
    bills = orders.select(F.col("id").alias("order_id"), F.col("payment_status").alias("_first"), "payment_method", "total")
    pays = F.col("kind").eqNullSafe("pay")
    method = clean.blank_to_null(F.lower("value"))
    rows = requests.select("id", "order_id", "kind", "created_at", F.when(pays, method).otherwise(F.col("value")).alias("value"))
    rows = rows.join(bills, "order_id", "left")
    error = (
        F.when(pays & ~F.col("value").isin(*METHODS), messages.BAD_METHOD)
        .when(~pays & ~F.coalesce(F.col("value").isin(*STATUSES), F.lit(False)), messages.BAD_STATUS)
        .when(F.col("_first").isNull(), messages.NO_ORDER)
    )
    rows = stage_table(rows.withColumn("error", error))
    order, slot = ["created_at", "id"], T.hour_slot(F.col("created_at"))
    at = F.struct(*order)
    valid = latest_before(
        rows.filter("error is null"), ["order_id"], order, slot,
        _set=F.when(~pays, F.struct(at.alias("at"), F.col("value").alias("v"))), _pay=F.when(pays, at),
    )
    start = F.coalesce("_set.v", "_first")
    paid_since = F.col("_pay").isNotNull() & (F.col("_set").isNull() | (F.col("_pay") > F.col("_set.at")))
    valid = valid.withColumn("old", F.when((start == "pending") & paid_since, "paid").otherwise(start))
    refused = pays & (F.col("old") == "cancelled")
    valid = valid.withColumn("error", F.when(refused, messages.NOT_PENDING))
    valid = valid.withColumn("new", F.when(~refused, F.when(pays, F.lit("paid")).otherwise(F.col("value")))).drop("_set", "_pay")
    valid = stage_table(valid)
    confirms = pays & (F.col("old") == "pending")
    valid = latest_before(valid, ["order_id"], order, slot, _method=F.when(confirms, F.col("value")))
    own = F.coalesce(F.col("value"), F.col("_method"), F.col("payment_method"))
    valid = valid.withColumn("method", F.when(confirms, own))
    out = ["id", "order_id", "kind", "value", "created_at", "old", "new", "method", "total", "error"]
    none = F.lit(None).cast("string")
    bad = rows.filter("error is not null").select("*", none.alias("old"), none.alias("new"), none.alias("method"))
    return valid.select(*out).unionByName(bad.select(*out))


def orders_after(orders: DataFrame, decided: DataFrame) -> DataFrame:
    """``orders`` (with ``paid_at``) after decided requests.

    The paid time is that of the first move to paid after the last return to pending; a confirmation sets it
    anew, setting the status keeps an older one, cancelling keeps it too.
    """
    at = F.struct("created_at", "id")
    moves = decided.filter("error is null and old <> new").select("order_id", "kind", "new", "method", "created_at", "id")
    ends = moves.groupBy("order_id").agg(
        F.max_by("new", at).alias("_status"),
        F.max_by("method", F.when(F.col("method").isNotNull(), at)).alias("_method"),
        F.max(F.when(F.col("new") == "pending", at)).alias("_reset"),
        F.max(F.when(F.col("kind") == "pay", at)).alias("_pay"),
    )
    paid = moves.filter("new = 'paid'").select("order_id", at.alias("_at")).join(ends.select("order_id", "_reset"), "order_id")
    paid = paid.filter(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))).groupBy("order_id").agg(F.min("_at.created_at").alias("_paid"))
    rows = orders.join(ends, orders.id == ends.order_id, "left").drop("order_id").join(paid.withColumnRenamed("order_id", "id"), "id", "left")
    # A stored time holds only until the bill has been pending or was confirmed; before that setting the status keeps it.
    kept = F.when(F.col("_reset").isNull() & ((F.col("payment_status") != "pending") | F.col("_pay").isNull()), F.col("paid_at"))
    return (
        rows.withColumn("paid_at", F.coalesce(kept, "_paid"))
        .withColumn("payment_status", F.coalesce("_status", "payment_status"))
        .withColumn("payment_method", F.coalesce("_method", "payment_method"))
        .select(*orders.columns)
    )


def audit(decided: DataFrame) -> DataFrame:
    """One audit row for each request that changed a bill."""
    moved = decided.filter("error is null and old <> new")
    opts = {"ignoreNullFields": "false"}
    paid = F.to_json(F.struct("method", "total"), opts)
    status = F.to_json(F.struct(F.col("old").alias("from"), F.col("new").alias("to")), opts)
    pays = F.col("kind") == "pay"
    return moved.select(
        "id", F.when(pays, "order.paid").otherwise("order.status").alias("action"), F.col("order_id").cast("string").alias("entity_id"),
        F.when(pays, paid).otherwise(status).alias("details"), "created_at",
    )
