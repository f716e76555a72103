"""Coupon pricing, limits and settlement over whole batches of bills."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import clean, labels, messages
from tillworks.functions import timeutil as T
from tillworks.operators import claims
from tillworks.operators.prefix import running_sum

AMOUNT = "decimal(18,2)"
COUPON_COLUMNS = [
    "code", "kind", "value", "max_discount", "min_bill", "buy_qty", "get_qty", "applies_to", "item_ids", "categories",
    "valid_from", "valid_to", "usage_limit", "per_customer_limit", "is_active",
]


def match_coupons(bills: DataFrame, coupons: DataFrame) -> DataFrame:
    """Bills ``(id, phone, created_at, code, ...)`` with the coupon their code names, if any."""
    coupon = coupons.select(F.upper("code").alias("_key"), F.col("id").alias("coupon_id"), *[F.col(c).alias(f"c_{c}") for c in COUPON_COLUMNS])
    keyed = bills.withColumn("code", clean.coupon_code_key(F.col("code")))
    return keyed.join(coupon, F.col("code") == F.col("_key"), "left").drop("_key")


def merged_lines(lines: DataFrame, menu: DataFrame) -> DataFrame:
    """Positive lines of active items, one per (bill, item), with price and category."""
    active = menu.filter("is_active").select(F.col("id").alias("menu_item_id"), "price", "category")
    merged = lines.filter("qty > 0").groupBy("order_id", "menu_item_id").agg(F.sum("qty").alias("qty"))
    return merged.join(active, "menu_item_id")


def coupon_lines(bills: DataFrame, lines: DataFrame, coupons: DataFrame, menu: DataFrame) -> DataFrame:
    """Lines of the bills that name a coupon, each marked whether the coupon covers it."""
    named = match_coupons(bills, coupons).filter("coupon_id is not null")
    scope = named.select(F.col("id").alias("order_id"), "coupon_id", "c_applies_to", "c_item_ids", "c_categories")
    rows = merged_lines(lines, menu).join(scope, "order_id")
    return rows.select("order_id", "coupon_id", "menu_item_id", "price", "qty", _covered().alias("eligible"))


def _covered() -> Column:
    """Whether the coupon covers a line: the whole bill, the item, or its category."""
    return (
        (F.col("c_applies_to") == "all")
        | F.array_contains("c_item_ids", F.col("menu_item_id"))
        | F.array_contains("c_categories", F.col("category"))
    )


def price_levels(covered: DataFrame) -> DataFrame:
    """Lines summed per bill, price and coverage.

    Pricing needs no more than this, and a bill never has more levels than the menu
    has prices, however many lines it has.
    """
    return covered.groupBy("order_id", "price", "eligible").agg(F.sum("qty").alias("units"))


def line_sums(levels: DataFrame) -> DataFrame:
    amount = F.col("price") * F.col("units")
    return levels.groupBy("order_id").agg(
        F.sum(amount).cast(AMOUNT).alias("subtotal"),
        F.coalesce(F.sum(F.when(F.col("eligible"), amount)), F.lit(0)).cast(AMOUNT).alias("eligible_amount"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("units"))), F.lit(0)).alias("eligible_units"),
    )


def free_units(levels: DataFrame, offers: DataFrame) -> DataFrame:
    """Buy-X-get-Y: the cheapest eligible units of each bill that are free.

    ``offers`` has ``(order_id, buy_qty, get_qty)``. A running unit count over the
    price levels says how many units of each level are free; no unit rows are made.
    Bills with too few units give zero.
    """
    by_bill = Window.partitionBy("order_id")
    upto = by_bill.orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = levels.filter("eligible").join(offers, "order_id")
    rows = rows.withColumn("_cum", F.sum("units").over(upto)).withColumn("_all", F.sum("units").over(by_bill))
    free = F.expr("(_all div (buy_qty + get_qty)) * get_qty")
    here = F.least(F.greatest(free - (F.col("_cum") - F.col("units")), F.lit(0)), F.col("units"))
    return rows.select("order_id", "price", here.alias("free"))


def bogo_discounts(levels: DataFrame, offers: DataFrame) -> DataFrame:
    return free_units(levels, offers).groupBy("order_id").agg(
        F.sum("free").alias("free_units"), F.sum(F.col("price") * F.col("free")).cast(AMOUNT).alias("bogo_discount")
    )


def percent_discount(eligible: Column, value: Column) -> Column:
    return F.round(eligible.cast(AMOUNT) * value * F.lit(Decimal("0.01")), 2).cast(AMOUNT)


def flat_discount(eligible: Column, value: Column) -> Column:
    return F.least(value.cast(AMOUNT), eligible.cast(AMOUNT))


def capped(discount: Column, cap: Column, subtotal: Column) -> Column:
    """``least`` skips nulls, so a coupon without a cap keeps its discount."""
    return F.least(discount.cast(AMOUNT), cap.cast(AMOUNT), subtotal.cast(AMOUNT))


def bill_sums(named: DataFrame, lines: DataFrame, menu: DataFrame) -> DataFrame:
    """Per bill: subtotal, covered amount and units, free units and their value, in one pass.

    ``named`` are bills with their coupon. Lines go straight to price levels (repeated
    items add up there), the free units come from a running count over the levels of a
    bill, and both sums close in the same grouping by bill.
    """
    scope = named.select(F.col("id").alias("order_id"), "c_applies_to", "c_item_ids", "c_categories", "c_buy_qty", "c_get_qty")
    active = menu.filter("is_active").select(F.col("id").alias("menu_item_id"), "price", "category")
    rows = lines.filter("qty > 0").join(active, "menu_item_id").join(scope, "order_id")
    levels = rows.groupBy("order_id", "price", _covered().alias("eligible"), "c_buy_qty", "c_get_qty").agg(F.sum("qty").alias("units"))
    # One partitioning by bill serves the running count and the final grouping.
    by_bill = Window.partitionBy("order_id")
    upto = by_bill.orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.when(F.col("eligible"), F.col("units")).otherwise(F.lit(0))
    levels = levels.withColumn("_before", F.sum(covered).over(upto) - F.col("units")).withColumn("_all", F.sum(covered).over(by_bill))
    free = F.expr("(_all div (c_buy_qty + c_get_qty)) * c_get_qty")
    here = F.when(F.col("eligible"), F.least(F.greatest(free - F.col("_before"), F.lit(0)), F.col("units")))
    amount = F.col("price") * F.col("units")
    hit = lambda c: F.coalesce(F.sum(F.when(F.col("eligible"), c)), F.lit(0))
    return levels.withColumn("_free", here).groupBy(F.col("order_id").alias("id")).agg(
        F.sum(amount).cast(AMOUNT).alias("subtotal"),
        hit(amount).cast(AMOUNT).alias("eligible_amount"),
        hit(F.col("units")).alias("eligible_units"),
        F.coalesce(F.sum("_free"), F.lit(0)).alias("free_units"),
        F.sum(F.when(F.col("c_buy_qty").isNotNull(), F.col("price") * F.col("_free"))).cast(AMOUNT).alias("bogo_discount"),
    )


def priced_bills(bills: DataFrame, lines: DataFrame, coupons: DataFrame, menu: DataFrame) -> DataFrame:
    """Bills with their coupon, line sums and the discount before any limit is tested."""
    matched = match_coupons(bills, coupons)
    rows = matched.join(bill_sums(matched.filter("coupon_id is not null"), lines, menu), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumn("subtotal", zero("subtotal").cast(AMOUNT)).withColumn("eligible_amount", zero("eligible_amount").cast(AMOUNT))
    rows = rows.withColumn("eligible_units", zero("eligible_units")).withColumn("free_units", zero("free_units"))
    raw = (
        F.when(F.col("c_kind") == "percent", percent_discount(F.col("eligible_amount"), F.col("c_value")))
        .when(F.col("c_kind") == "flat", flat_discount(F.col("eligible_amount"), F.col("c_value")))
        .otherwise(F.col("bogo_discount"))
    )
    return rows.withColumn("discount", capped(raw, F.col("c_max_discount"), F.col("subtotal")))


def early_reason(today: Column) -> Column:
    """First failing test before the limits, in the order a cashier would see them."""
    return (
        F.when(F.col("code") == "", "no code")
        .when(F.col("coupon_id").isNull(), "unknown")
        .when(~F.col("c_is_active"), "off")
        .when(today < F.col("c_valid_from"), "not started")
        .when(today > F.col("c_valid_to"), "expired")
        .when(F.col("subtotal") < F.col("c_min_bill"), "below minimum")
        .when(F.col("eligible_units") == 0, "nothing covered")
    )


def bogo_short() -> Column:
    return F.coalesce((F.col("c_kind") == "bogo") & (F.col("free_units") == 0), F.lit(False))


def verdict(early: Column, used: Column, used_by_phone: Column) -> Column:
    """Reason a bill's coupon is refused, null when it is accepted."""
    per_customer = F.col("c_per_customer_limit")
    return (
        F.when(early.isNotNull(), early)
        .when(used >= F.col("c_usage_limit"), "used up")
        .when(per_customer.isNotNull() & F.col("phone").isNull(), "needs phone")
        .when(used_by_phone >= per_customer, "customer limit")
        .when(bogo_short(), "too few items")
    )


QUOTE_COLUMNS = ["id", "code", "coupon_id", "subtotal", "discount", "total", "reason"]


def _quoted(rows: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    named = F.col("coupon_id").isNotNull()
    return rows.select(
        "id",
        "code",
        "coupon_id",
        F.when(named, F.col("subtotal")).alias("subtotal"),
        F.when(ok, F.col("discount")).alias("discount"),
        F.when(ok, F.col("subtotal") - F.col("discount")).cast(AMOUNT).alias("total"),
        "reason",
    )


def refusal_texts(quoted: DataFrame, coupons: DataFrame, currency: str) -> DataFrame:
    """Quoted bills with ``message``: the sentence that goes with a refusal, null for accepted ones."""
    facts = F.struct("valid_from", "valid_to", "min_bill", "per_customer_limit", "buy_qty", "get_qty")
    rows = quoted.join(coupons.select(F.col("id").alias("coupon_id"), facts.alias("_coupon")), "coupon_id", "left")
    return rows.withColumn("message", messages.coupon_refusal(F.col("reason"), F.col("code"), F.col("_coupon"), currency)).drop("_coupon")


def coupon_uses(orders: DataFrame) -> DataFrame:
    """Bills that used each coupon, cancelled ones aside, and what they saved."""
    used = orders.filter("coupon_id is not null and payment_status <> 'cancelled'")
    return used.groupBy("coupon_id").agg(F.count("*").alias("uses"), F.sum("discount").cast("decimal(24,2)").alias("given"))


def customer_uses(orders: DataFrame) -> DataFrame:
    used = orders.filter("coupon_id is not null and phone is not null and payment_status <> 'cancelled'")
    return used.groupBy("coupon_id", "phone").agg(F.count("*").alias("uses"))


def quote(bills: DataFrame, lines: DataFrame, coupons: DataFrame, menu: DataFrame, past: DataFrame, as_of=None) -> DataFrame:
    """Quotes bills against the uses of past orders; nothing is consumed.

    Validity is tested on the bill's own local day, or on that of ``as_of``.
    """
    today = T.local_day(F.col("created_at") if as_of is None else T.instant(as_of))
    rows = priced_bills(bills, lines, coupons, menu)
    rows = rows.join(coupon_uses(past).select("coupon_id", F.col("uses").alias("_used")), "coupon_id", "left")
    rows = rows.join(customer_uses(past).select("coupon_id", "phone", F.col("uses").alias("_mine")), ["coupon_id", "phone"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _quoted(rows.withColumn("reason", verdict(early_reason(today), zero("_used"), zero("_mine"))))


def limit_ranks(priced: DataFrame) -> DataFrame:
    """Bills that reach the limit tests, with the uses before them.

    ``_mine``: earlier passing bills of the same coupon and phone; ``_used``: earlier
    bills of the coupon that also kept within the customer limit. Counting is
    two-level (see :mod:`tillworks.operators.prefix`), so one popular coupon or one
    busy phone does not fill one task. A cancelled bill uses up nothing; status is
    taken as it stands in the input.
    """
    rows = priced.filter(early_reason(T.local_day(F.col("created_at"))).isNull())
    limited = F.col("c_per_customer_limit").isNotNull()
    passes = ~bogo_short() & (~limited | F.col("phone").isNotNull()) & (F.col("payment_status") != "cancelled")
    rows = rows.withColumn("_pass", passes.cast("bigint"))
    order = ["created_at", "id"]
    hour = T.hour_slot(F.col("created_at"))
    personal = limited & F.col("phone").isNotNull()
    counted = running_sum(rows.filter(personal), ["coupon_id", "phone"], order, F.floor(hour / 24), _upto=F.col("_pass"))
    counted = counted.withColumn("_mine", F.col("_upto") - F.col("_pass")).drop("_upto")
    both = counted.unionByName(rows.filter(~personal).withColumn("_mine", F.lit(0).cast("bigint")))
    kept = F.when(~limited | (F.col("_mine") < F.col("c_per_customer_limit")), F.col("_pass")).otherwise(F.lit(0))
    ranked = running_sum(both.withColumn("_kept", kept), ["coupon_id"], order, hour, _upto=F.col("_kept"))
    return ranked.withColumn("_used", F.col("_upto") - F.col("_kept"))


def settle(priced: DataFrame) -> DataFrame:
    """Applies both limits to a batch of priced bills in time order; adds ``reason``."""
    early = early_reason(T.local_day(F.col("created_at")))
    decided = limit_ranks(priced).withColumn("reason", verdict(F.lit(None).cast("string"), F.col("_used"), F.col("_mine")))
    refused = priced.withColumn("reason", early).filter("reason is not null")
    return decided.select(*priced.columns, "reason").unionByName(refused.select(*priced.columns, "reason"))


def settlement(bills: DataFrame, lines: DataFrame, coupons: DataFrame, menu: DataFrame) -> DataFrame:
    """Prices a batch and settles both limits.

    The priced bills feed every counting step, so they are written once to the
    shared folder instead of being priced again for each.
    """
    return _quoted(settle(stage_table(priced_bills(bills, lines, coupons, menu))))


def _limits(rows: DataFrame) -> DataFrame:
    """One row per limit a bill's coupon sets it: (bill, at, resource, need, limit, kind, until)."""
    total = F.struct(F.concat(F.lit("coupon "), F.col("coupon_id").cast("string")).alias("resource"), F.col("c_usage_limit").cast("bigint").alias("limit"), F.lit("used").alias("kind"))
    named = F.concat(F.lit("coupon "), F.col("coupon_id").cast("string"), F.lit(" of "), F.col("phone"))
    personal = F.struct(named.alias("resource"), F.col("c_per_customer_limit").cast("bigint").alias("limit"), F.lit("mine").alias("kind"))
    each = rows.select(F.col("id").alias("bill"), T.micros(F.col("created_at")).alias("at"), F.lit(1).cast("bigint").alias("need"), "until", F.inline(F.array(total, personal)))
    return each.filter("resource is not null and limit is not null")


def stored_uses(stored: DataFrame, cancels: DataFrame) -> DataFrame:
    """Uses by stored bills ``(id, coupon_id, phone, created_at)`` as changes over time.

    A use counts from the bill on until it is cancelled; ``cancels``: (id, at).
    """
    used = stored.filter("coupon_id is not null").join(cancels.groupBy("id").agg(F.min("at").alias("gone")), "id", "left")
    name = F.concat(F.lit("coupon "), F.col("coupon_id").cast("string"))
    names = F.explode(F.array_compact(F.array(name, F.concat(name, F.lit(" of "), F.col("phone")))))
    both = used.select("created_at", "gone", names.alias("resource"))
    step = lambda at, n: F.struct(T.micros(F.col(at)).alias("time"), F.lit(n).cast("bigint").alias("amount"))
    return both.select("resource", F.inline(F.array(step("created_at", 1), step("gone", -1)))).filter("time is not null")


def fails_by_itself() -> Column:
    """Whether a priced bill's coupon is refused whatever others have used."""
    no_phone = F.col("c_per_customer_limit").isNotNull() & F.col("phone").isNull()
    return early_reason(T.local_day(F.col("created_at"))).isNotNull() | bogo_short() | no_phone


def limit_steps(priced: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every limit that a batch looks at, and the capacities.

    A bill that fails by itself may still look at limits, as they come first in the order of reasons.
    """
    gone = cancels.groupBy("id").agg(T.micros(F.min("at")).alias("until"))
    seen = _limits(priced.filter(early_reason(T.local_day(F.col("created_at"))).isNull()).join(gone, "id", "left"))
    return seen, seen.groupBy("resource").agg(F.max("limit").alias("capacity"))


def limit_reasons(priced: DataFrame, used: DataFrame) -> DataFrame:
    """Adds ``reason`` to priced bills; ``used``: (bill, kind, used) for the limits that were looked at."""
    zero = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("used"))), F.lit(0)).alias(f"_{kind}")
    seen = used.groupBy(F.col("bill").alias("id")).agg(zero("used"), zero("mine"))
    reason = verdict(early_reason(T.local_day(F.col("created_at"))), F.coalesce("_used", F.lit(0)), F.coalesce("_mine", F.lit(0)))
    return priced.join(seen, "id", "left").withColumn("reason", reason).drop("_used", "_mine")


def settlement_over_time(bills: DataFrame, lines: DataFrame, coupons: DataFrame, menu: DataFrame, stored: DataFrame, cancels: DataFrame) -> DataFrame:
    """Settles a batch against stored bills, with cancellations that give uses back.

    Bills, stored uses and cancellations ``(id, at)`` of either run through one sequence: a bill is
    tested against what holds a use at its instant, so one that comes after a cancellation gets
    the freed use. At the same instant cancellations come first, then stored bills, then the batch by id.
    Settling a batch in two parts, the second against the first's accepted bills, gives the same.
    """
    priced = stage_table(priced_bills(bills, lines, coupons, menu))
    changes = stage_table(stored_uses(stored, cancels))
    seen, capacity = limit_steps(priced, cancels)
    seen = stage_table(seen)
    asked = seen.join(priced.filter(fails_by_itself()).select(F.col("id").alias("bill")), "bill", "left_anti")
    taken = claims.accepted_claims(asked, claims.decide(asked, capacity, changes))
    return _quoted(limit_reasons(priced, claims.used_before(seen.select("bill", "at", "resource", "need", "kind"), taken, changes)))


def catalogue(coupons: DataFrame, orders: DataFrame, as_of, currency: str) -> DataFrame:
    """Every coupon with its uses, discount given, state and labels; active first, newest first."""
    uses = coupon_uses(orders).withColumnRenamed("coupon_id", "id")
    rows = coupons.join(uses, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    state = labels.coupon_state(F.col("is_active"), F.col("valid_from"), F.col("valid_to"), F.col("usage_limit"), F.col("uses"), T.local_day(T.instant(as_of)))
    offer = labels.coupon_offer(F.col("kind"), F.col("value"), F.col("max_discount"), F.col("min_bill"), F.col("buy_qty"), F.col("get_qty"), currency)
    return rows.select(
        "id",
        "code",
        "is_active",
        "created_at",
        "uses",
        F.coalesce("given", F.lit(0)).cast("decimal(24,2)").alias("discount_given"),
        state.alias("state"),
        offer.alias("offer"),
        labels.coupon_validity(F.col("valid_from"), F.col("valid_to")).alias("validity"),
    ).orderBy(F.desc("is_active"), F.desc("created_at"), F.desc("id"))


def scope_labels(coupons: DataFrame, menu: DataFrame) -> DataFrame:
    """What each coupon covers: the first three names, then how many more; deleted items are marked."""
    listed = coupons.select("id", F.posexplode_outer("item_ids").alias("pos", "item_id"))
    names = menu.select(F.col("id").alias("item_id"), "name")
    named = listed.filter("item_id is not null").join(names, "item_id", "left")
    label = F.coalesce("name", F.concat(F.lit("#"), F.col("item_id").cast("string"), F.lit(" (deleted)")))
    items = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", label.alias("label")))).alias("_items"))
    rows = coupons.select("id", "code", "applies_to", "categories").join(items, "id", "left")
    cats = F.transform("categories", lambda c: F.concat(c, F.lit(" (category)")))
    texts = F.concat(cats, F.coalesce(F.transform("_items", lambda i: i["label"]), F.array().cast("array<string>")))
    shown = F.array_join(F.slice(texts, 1, 3), ", ")
    more = F.when(F.size(texts) > 3, F.concat(F.lit(" +"), (F.size(texts) - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return rows.select("id", "code", F.when(F.col("applies_to") == "all", F.lit("Whole bill")).otherwise(F.concat(shown, more)).alias("scope"))
