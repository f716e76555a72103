"""Stock: availability, needs of bills, and the movement ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import clean, messages
from tillworks.functions import timeutil as T
from tillworks.operators import claims
from tillworks.operators.prefix import running_balance, running_sum

QTY = "decimal(14,3)"
MAX_QTY = 1_000_000_000
MAX_CAN_MAKE = 1_000_000
MANUAL_KINDS = ("purchase", "waste", "count")


def menu_stock(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Per item with tracked ingredients: how many can be made, its state, and what is short.

    ``short`` lists (name, unit, stock, need) of short or low ingredients, scarcest first.
    """
    part = ingredients.filter("track_stock").select(F.col("id").alias("ingredient_id"), "name", "unit", "stock", "low_stock_at")
    rows = recipes.withColumnRenamed("qty", "need").join(part, "ingredient_id")
    ratio = F.col("stock") / F.col("need")
    at_alert = F.coalesce(F.col("stock") <= F.col("low_stock_at"), F.lit(False))
    entry = F.struct(ratio.alias("ratio"), "name", "unit", "stock", "need")
    grouped = rows.groupBy("menu_item_id").agg(
        F.min(ratio).alias("_ratio"),
        F.bool_or(at_alert).alias("_low"),
        F.array_sort(F.collect_list(F.when((F.col("stock") < F.col("need")) | at_alert, entry))).alias("_short"),
    )
    can_make = F.least(F.greatest(F.floor("_ratio"), F.lit(0)), F.lit(MAX_CAN_MAKE)).cast("int")
    status = F.when(F.col("_ratio") < 1, "out").when(F.col("_low"), "low").otherwise("ok")
    return grouped.select("menu_item_id", can_make.alias("can_make"), status.alias("status"), F.col("_short").alias("short"))


def sellable_menu(menu: DataFrame, stock: DataFrame, hide_out_of_stock: bool) -> DataFrame:
    """Active items as offered on a new bill.

    With hiding on, items that cannot be made are dropped and the quantity is capped
    at what can be made; otherwise they stay and carry a warning.
    """
    rows = menu.filter("is_active").join(stock.select(F.col("menu_item_id").alias("id"), "can_make", "status"), "id", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("ok")))
    if hide_out_of_stock:
        return rows.filter("status <> 'out'").select("id", "name", "status", F.col("can_make").alias("max_qty"), F.lit(False).alias("warn"))
    return rows.select("id", "name", "status", F.lit(None).cast("int").alias("max_qty"), (F.col("status") == "out").alias("warn"))


def bill_needs(order_ingredients: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Quantity of each tracked ingredient a bill takes."""
    need = order_ingredients.groupBy("order_id", "ingredient_id").agg(F.sum("qty").cast(QTY).alias("need"))
    tracked = ingredients.filter("track_stock").select(F.col("id").alias("ingredient_id"))
    return need.join(tracked, "ingredient_id", "left_semi").select("order_id", "ingredient_id", "need")


def net_movements(movements: DataFrame) -> DataFrame:
    """What each bill still has deducted, as the quantity to give back; settled bills drop out."""
    back = movements.filter("order_id is not null").groupBy("order_id", "ingredient_id").agg((-F.sum("qty")).cast(QTY).alias("back"))
    return back.filter("back <> 0")


def touched_ingredients(ingredients: DataFrame, movements: DataFrame) -> DataFrame:
    """Ingredients that any bill movement touches."""
    hit = movements.filter("order_id is not null").select(F.col("ingredient_id").alias("id"))
    return ingredients.join(hit, "id", "left_semi")


def signed(kind: Column, qty: Column) -> Column:
    return F.when(kind.isin("purchase", "sale_reversal"), qty).when(kind.isin("waste", "sale"), -qty)


def input_error(kind: Column, qty: Column) -> Column:
    """Why a stock input is refused, null when it is fine."""
    absent = qty.isNull()
    return (
        F.when((kind == "count") & (absent | (qty < 0) | (qty > MAX_QTY)), messages.BAD_COUNT)
        .when((kind != "count") & (absent | (qty <= 0) | (qty > MAX_QTY)), messages.BAD_QUANTITY)
    )


def stock_ledger(events: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Movement rows with the balance after each: purchases and reversals add, waste and sales
    subtract, a count sets the balance and is stored as an adjustment of the difference."""
    ok = events.filter(input_error(F.col("kind"), F.col("qty")).isNull())
    wide = F.col("qty").cast("decimal(24,3)")
    is_count = F.col("kind") == "count"
    opening = ingredients.select(F.col("id").alias("ingredient_id"), F.col("stock").cast("decimal(24,3)").alias("opening"))
    rows = running_balance(
        ok, ["ingredient_id"], ["created_at", "id"], T.hour_slot(F.col("created_at")), signed(F.col("kind"), wide), F.when(is_count, wide), opening
    )
    return rows.select(
        "id",
        "ingredient_id",
        F.when(is_count, "adjust").otherwise(F.col("kind")).alias("kind"),
        (F.col("after") - F.col("before")).cast("decimal(24,3)").alias("qty"),
        F.col("after").cast("decimal(24,3)").alias("balance_after"),
        "order_id",
        "created_at",
    )


def stock_inputs(inputs: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Purchases, waste and counts typed in by hand: every input with its ``error``, or with the balance it leaves.

    ``inputs`` are (id, ingredient_id, kind, qty, note, created_at). The first broken rule refuses an input: its kind,
    its quantity, its note, its ingredient. Refused inputs move nothing and keep their row. Adds ``name``, ``unit``,
    ``before`` and ``after``.
    """
    known = ingredients.select(F.col("id").alias("ingredient_id"), "name", "unit")
    kind, note = F.col("kind"), clean.blank_to_null(F.col("note"))
    error = (
        F.when(~F.coalesce(kind.isin(*MANUAL_KINDS), F.lit(False)), messages.BAD_STOCK_KIND)
        .when(input_error(kind, F.col("qty")).isNotNull(), input_error(kind, F.col("qty")))
        .when(F.length(note) > 200, messages.LONG_NOTE)
        .when(F.col("name").isNull(), messages.NO_INGREDIENT)
    )
    checked = inputs.join(known, "ingredient_id", "left").withColumn("note", note).withColumn("error", error)
    moved = stock_ledger(checked.filter("error is null").withColumn("order_id", F.lit(None).cast("bigint")), ingredients)
    moved = moved.select("id", F.col("balance_after").alias("after"), (F.col("balance_after") - F.col("qty")).cast("decimal(24,3)").alias("before"))
    return checked.join(moved, "id", "left").select("id", "ingredient_id", "name", "unit", "kind", "qty", "note", "created_at", "error", "before", "after")


def ingredients_after(ingredients: DataFrame, inputs: DataFrame) -> DataFrame:
    """The ingredients after decided inputs: the last balance, and tracking switched on by any input taken."""
    last = inputs.filter("error is null").groupBy(F.col("ingredient_id").alias("id")).agg(F.max_by("after", F.struct("created_at", "id")).alias("_after"))
    rows = ingredients.join(last, "id", "left")
    stock = F.coalesce("_after", "stock").cast("decimal(24,3)")
    return rows.withColumn("stock", stock).withColumn("track_stock", F.col("track_stock") | F.col("_after").isNotNull()).drop("_after")


def input_audit(inputs: DataFrame) -> DataFrame:
    """One audit row for each input taken."""
    details = F.to_json(F.struct("name", "unit", "qty", "before", "after", "note"), {"ignoreNullFields": "false"})
    return inputs.filter("error is null").select("id", F.concat(F.lit("stock."), "kind").alias("action"), F.col("ingredient_id").cast("string").alias("entity_id"), details.alias("details"))


def deduct_sales(needs: DataFrame, orders: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Warn mode: every bill is taken in time order and stock may go below zero.

    One ``sale`` movement per bill and ingredient; ``warn`` marks those that leave
    the balance negative.
    """
    when = orders.select(F.col("id").alias("order_id"), "created_at")
    rows = needs.join(when, "order_id")
    rows = running_sum(rows, ["ingredient_id"], ["created_at", "order_id"], T.hour_slot(F.col("created_at")), taken=F.col("need").cast("decimal(24,3)"))
    start = ingredients.select(F.col("id").alias("ingredient_id"), "stock")
    balance = (F.col("stock") - F.col("taken")).cast("decimal(24,3)")
    return rows.join(start, "ingredient_id").select(
        "order_id", "ingredient_id", (-F.col("need")).cast(QTY).alias("qty"), balance.alias("balance_after"), (balance < 0).alias("warn"), "created_at"
    )


def status_moves(changes: DataFrame, needs: DataFrame) -> DataFrame:
    """Movements caused by payment-status changes ``(order_id, old, new, created_at)``:
    cancelling gives a bill's ingredients back, un-cancelling takes them again."""
    gives = F.col("new") == "cancelled"
    turn = changes.filter(gives | (F.col("old") == "cancelled"))
    return turn.join(needs, "order_id").select(
        "order_id",
        "ingredient_id",
        F.when(gives, "sale_reversal").otherwise("sale").alias("kind"),
        F.when(gives, F.col("need")).otherwise(-F.col("need")).cast(QTY).alias("qty"),
        "created_at",
    )


def deleted_order_moves(deleted: DataFrame, needs: DataFrame) -> DataFrame:
    """Deleting a bill that was not cancelled gives its ingredients back."""
    live = deleted.filter("payment_status <> 'cancelled'").select(F.col("id").alias("order_id"))
    return needs.join(live, "order_id", "left_semi").select("order_id", "ingredient_id", F.lit("sale_reversal").alias("kind"), F.col("need").alias("qty"))


def latest_movements(movements: DataFrame, n: int = 50) -> DataFrame:
    """Newest movements of every ingredient; the top ``n`` are cut per map task before the shuffle."""
    w = Window.partitionBy("ingredient_id").orderBy(F.desc("created_at"), F.desc("id"))
    keep = min(max(n, 1), 200)
    return movements.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= keep)


def deduct_sales_blocking(needs: DataFrame, orders: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Block mode: a bill is refused whole when any tracked ingredient is short.

    Whether a bill fits depends on earlier accepted bills over shared ingredients, see
    :mod:`tillworks.operators.claims`. Returns ``(order_id, accepted)`` for every bill with a
    tracked need.
    """
    asked, stock = stock_claims(needs, orders, ingredients)
    return claims.decide(asked, stock).withColumnRenamed("bill", "order_id")


def stock_claims(needs: DataFrame, orders: DataFrame, ingredients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of bills on stock and the stock itself, in thousandths of a unit."""
    when = orders.select(F.col("id").alias("order_id"), "created_at")
    name = lambda c: F.concat(F.lit("stock "), F.col(c).cast("string")).alias("resource")
    thousandths = lambda c: (F.col(c) * 1000).cast("bigint")
    asked = needs.join(when, "order_id").select(
        F.col("order_id").alias("bill"), T.micros(F.col("created_at")).alias("at"), name("ingredient_id"), thousandths("need").alias("need"), F.lit(None).cast("bigint").alias("until")
    )
    return asked, ingredients.select(name("id"), thousandths("stock").alias("capacity"))
