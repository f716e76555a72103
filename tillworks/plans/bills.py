"""Bill intake: from raw payloads to accepted orders, lines, ingredients and customers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import clean, messages
from tillworks.functions import timeutil as T
from tillworks.operators import claims
from tillworks.operators import coupons as C
from tillworks.operators import stock as S
from tillworks.operators.prefix import running_last
from tillworks.sources import payloads

AMOUNT = C.AMOUNT


def recipe_explosion(lines: DataFrame, recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """One row per order line and recipe ingredient, with the ingredient's name and unit frozen.

    Neither dimension is hinted: Spark broadcasts them while they are small and
    splits skewed join partitions at run time when they are not.
    """
    part = ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name"), "unit")
    recipe = recipes.withColumnRenamed("qty", "per_unit").join(part, "ingredient_id")
    keep = [c for c in lines.columns if c != "qty"]
    return lines.join(recipe, "menu_item_id").select(
        *keep, "ingredient_id", "ingredient_name", "unit", (F.col("per_unit") * F.col("qty")).cast("decimal(14,3)").alias("qty")
    )


def opening_payment(method: Column, created_at: Column) -> tuple[Column, Column]:
    """Payment state and time of a new bill: UPI waits for confirmation, cash and card are paid at once."""
    waits = method == "upi"
    return F.when(waits, "pending").otherwise("paid"), F.when(~waits, created_at)


def preview_input(bills: DataFrame) -> DataFrame:
    """Raw bills whose phone and items are acceptable, ready for a coupon quote."""
    phone = clean.digits(F.col("phone"))
    return bills.filter(clean.phone_ok(phone) & payloads.is_filled_array(F.col("items"))).select(
        "id", phone.alias("phone"), "created_at", F.lit("paid").alias("payment_status"), F.col("coupon_code").alias("code")
    )


def priced_lines(lines: DataFrame, menu: DataFrame) -> DataFrame:
    """Payload lines of active items with a positive quantity, named and priced from the menu; the rest drop out."""
    active = menu.filter("is_active").select(F.col("id").alias("menu_item_id"), "name", "price", "category")
    return lines.filter("qty > 0").join(active, "menu_item_id")


def checked_bills(bills: DataFrame) -> DataFrame:
    """Cleaned bills with ``error``, the first broken input rule."""
    rows = bills.select(
        "id", "created_at", "created_by", "items",
        clean.digits(F.col("phone")).alias("phone"),
        clean.blank_to_null(F.col("customer_name")).alias("name"),
        clean.payment_method(F.col("payment_method")).alias("method"),
        clean.coupon_code_key(F.col("coupon_code")).alias("code"),
    )
    error = clean.first_violation(
        (~clean.phone_ok(F.col("phone")), messages.BAD_PHONE),
        (~F.col("method").isin(*clean.PAYMENT_METHODS), messages.BAD_METHOD),
        (~payloads.is_filled_array(F.col("items")), messages.NO_ITEMS),
        (payloads.has_bad_line(F.col("items")), messages.BAD_BILL_LINE),
    )
    return rows.withColumn("error", error)


@dataclass(frozen=True)
class Intake:
    orders: DataFrame
    items: DataFrame
    ingredients: DataFrame
    customers: DataFrame
    rejects: DataFrame


def bill_intake(bills: DataFrame, menu: DataFrame, recipes: DataFrame, ingredients: DataFrame, coupons: DataFrame, customers: DataFrame) -> Intake:
    """Takes a batch of raw bills in time order.

    The accept decision is a column computed before anything is written: input rules,
    then the coupon (a refused coupon refuses the bill), then at least one valid line.
    The cleaned bills and the decided bills are each written once to the shared folder:
    the first feed every test, the second every output. Stock is deducted afterwards (see :mod:`tillworks.operators.stock`).
    """
    checked = stage_table(checked_bills(bills))
    ok = checked.filter("error is null")
    lines = priced_lines(payloads.explode_bill_items(ok), menu)
    sums = lines.groupBy("bill_id").agg(F.sum(F.col("price") * F.col("qty")).cast(AMOUNT).alias("subtotal"))
    asking = ok.filter("code <> ''").select("id", "phone", "created_at", F.lit("paid").alias("payment_status"), "code")
    bare_lines = lines.select(F.col("bill_id").alias("order_id"), "menu_item_id", "qty")
    settled = C.settlement(asking, bare_lines, coupons, menu).select(
        F.col("id").alias("bill_id"), "coupon_id", F.col("discount").alias("coupon_discount"), F.concat(F.lit("Coupon refused: "), F.col("reason")).alias("coupon_error")
    )
    rows = checked.withColumn("bill_id", F.col("id")).join(sums, "bill_id", "left").join(settled, "bill_id", "left")
    no_line = F.when(F.col("subtotal").isNull(), messages.NO_VALID_ITEMS)
    rows = rows.withColumn("error", F.coalesce("error", "coupon_error", no_line))
    decided = stage_table(rows.drop("items", "coupon_error", "bill_id"))

    return _taken(decided, lines, recipes, ingredients, customers)


def _taken(decided: DataFrame, lines: DataFrame, recipes: DataFrame, ingredients: DataFrame, customers: DataFrame) -> Intake:
    """The tables that follow from the decisions."""
    taken = decided.filter("error is null")
    named = _customer_names(taken, customers)
    status, paid_at = opening_payment(F.col("method"), F.col("created_at"))
    discount = F.least(F.coalesce("coupon_discount", F.lit(0)).cast(AMOUNT), F.col("subtotal"))
    orders = named.select(
        "id", "phone", "customer_name", "subtotal", discount.alias("discount"), (F.col("subtotal") - discount).cast(AMOUNT).alias("total"),
        "coupon_id", F.when(F.col("coupon_id").isNotNull(), F.col("code")).alias("coupon_code"), status.alias("payment_status"),
        F.col("method").alias("payment_method"), paid_at.alias("paid_at"), F.lit("new").alias("kitchen_status"), "created_by", "created_at",
    )
    kept = lines.join(taken.select(F.col("id").alias("bill_id")), "bill_id", "left_semi")
    items = kept.select(F.col("bill_id").alias("order_id"), "line_no", "menu_item_id", F.col("name").alias("item_name"), "price", "qty")
    frozen = recipe_explosion(items.select("order_id", "line_no", "menu_item_id", "qty"), recipes, ingredients)
    return Intake(orders, items, frozen, upsert_customers(taken, customers), decided.filter("error is not null").select("id", "error"))


def bill_intake_with_stock(
    bills: DataFrame, menu: DataFrame, recipes: DataFrame, ingredients: DataFrame, coupons: DataFrame, customers: DataFrame, stored: DataFrame, cancels: DataFrame, block: bool
) -> tuple[Intake, DataFrame]:
    """Takes raw bills in time order with coupon limits and stock in one decision.

    A bill asks for a use of its coupon and, if ``block``, for the tracked ingredients of its lines;
    when either is short it is refused whole and leaves both to later bills. ``stored`` bills hold
    coupon uses, ``cancels`` (id, at) give them back (of a bill of the batch too; its stock stays taken,
    as it is put back by the restore job). Without ``block`` every bill takes its stock.

    Returns the intake and its movements ``(order_id, ingredient_id, qty, balance_after, warn, created_at)``; ``warn``
    marks a balance below zero. Rejects name the first failing rule; short stock names the first short ingredient by id.
    """
    checked = stage_table(checked_bills(bills))
    ok = checked.filter("error is null")
    lines = stage_table(priced_lines(payloads.explode_bill_items(ok), menu))
    sums = lines.groupBy("bill_id").agg(F.sum(F.col("price") * F.col("qty")).cast(AMOUNT).alias("subtotal"))
    asking = ok.filter("code <> ''").select("id", "phone", "created_at", F.lit("paid").alias("payment_status"), "code")
    priced = stage_table(C.priced_bills(asking, lines.select(F.col("bill_id").alias("order_id"), "menu_item_id", "qty"), coupons, menu))
    needs = S.bill_needs(recipe_explosion(lines.select(F.col("bill_id").alias("order_id"), "menu_item_id", "qty"), recipes, ingredients), ingredients)
    needs = stage_table(needs)

    changes = stage_table(C.stored_uses(stored, cancels))
    seen, capacity = C.limit_steps(priced, cancels)
    seen = seen.select("bill", "at", "resource", "need", "until", "kind", F.lit(None).cast("bigint").alias("ingredient_id"), "limit")
    if block:
        wanted, left = S.stock_claims(needs, checked, ingredients)
        part = F.substring_index("resource", " ", -1).cast("bigint").alias("ingredient_id")
        wanted = wanted.join(left, "resource").select("bill", "at", "resource", "need", "until", F.lit("stock").alias("kind"), part, F.col("capacity").alias("limit"))
        seen, capacity = seen.unionByName(wanted), capacity.unionByName(left)
    seen = stage_table(seen)
    # A bill that is refused in any case, for its coupon or for want of a valid line, claims nothing.
    refused = priced.filter(C.fails_by_itself()).select(F.col("id").alias("bill"))
    hopeful = sums.select(F.col("bill_id").alias("bill")).join(refused, "bill", "left_anti")
    asked = stage_table(seen.join(hopeful, "bill", "left_semi"))
    taken = stage_table(claims.accepted_claims(asked, claims.decide(asked, capacity, changes)))
    used = stage_table(claims.used_before(seen.select("bill", "at", "resource", "need", "kind", "ingredient_id", "limit"), taken, changes))

    coupon = C.limit_reasons(priced, used).select(
        F.col("id").alias("bill_id"), "coupon_id", F.col("discount").alias("coupon_discount"), F.concat(F.lit("Coupon refused: "), F.col("reason")).alias("coupon_error")
    )
    lacking = used.filter("kind = 'stock' and used + need > limit").groupBy(F.col("bill").alias("bill_id")).agg(F.min_by(F.struct("ingredient_id", "need", (F.col("limit") - F.col("used")).alias("left")), "ingredient_id").alias("lack"))
    names = ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient"), "unit")
    lacking = lacking.select("bill_id", "lack.*").join(names, "ingredient_id").select("bill_id", messages.short_stock(*[F.col(c) for c in ("ingredient", "left", "unit", "need")]).alias("stock_error"))
    rows = checked.withColumn("bill_id", F.col("id")).join(sums, "bill_id", "left").join(coupon, "bill_id", "left").join(lacking, "bill_id", "left")
    no_line = F.when(F.col("subtotal").isNull(), messages.NO_VALID_ITEMS)
    rows = rows.withColumn("error", F.coalesce("error", "coupon_error", no_line, "stock_error"))
    decided = stage_table(rows.drop("items", "coupon_error", "stock_error", "bill_id"))
    kept = needs.join(decided.filter("error is null").select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return _taken(decided, lines, recipes, ingredients, customers), S.deduct_sales(kept, decided, ingredients)


def _customer_names(taken: DataFrame, customers: DataFrame) -> DataFrame:
    """Bill name: its own, else the customer's latest name at that moment, else the stored one."""
    known = taken.filter("phone is not null")
    rows = running_last(known, ["phone"], ["created_at", "id"], F.floor(T.hour_slot(F.col("created_at")) / 24), "name", "_latest")
    stored = customers.select("phone", F.col("name").alias("_stored"))
    rows = rows.join(stored, "phone", "left").withColumn("customer_name", F.coalesce("_latest", "_stored")).drop("_latest", "_stored")
    walk_in = taken.filter("phone is null").withColumn("customer_name", F.col("name"))
    return rows.unionByName(walk_in)


def upsert_customers(taken: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers after a batch: the latest given name per phone, the old name where none was given."""
    at = F.struct("created_at", "id")
    fresh = taken.filter("phone is not null").groupBy("phone").agg(F.max_by("name", F.when(F.col("name").isNotNull(), at)).alias("_name"))
    return customers.select("phone", "name").join(fresh, "phone", "full_outer").select("phone", F.coalesce("_name", "name").alias("name"))
