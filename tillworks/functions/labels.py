"""Status badges and labels shown beside the numbers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

LATE_MINUTES = 15
VERY_LATE_MINUTES = 25

# Payment method names and audit action names.
METHOD_NAMES = {"cash": "Cash", "upi": "UPI", "card": "Card", "unknown": "Not recorded"}

ACTION_NAMES = {
    "order.status": "Bill status changed",
    "order.paid": "Payment confirmed",
    "order.delete": "Bill deleted",
    "kitchen.status": "Kitchen status changed",
    "stock.purchase": "Stock purchased",
    "stock.waste": "Waste recorded",
    "stock.count": "Stock counted",
    "stock.settings": "Stock tracking changed",
    "menu.create": "Menu item added",
    "menu.update": "Menu item edited",
    "menu.delete": "Menu item deleted",
    "menu.recipe": "Recipe changed",
    "ingredient.create": "Ingredient added",
    "ingredient.update": "Ingredient edited",
    "ingredient.delete": "Ingredient deleted",
    "staff.create": "User added",
    "staff.update": "User edited",
    "staff.delete": "User deleted",
    "staff.sign_out": "User signed out",
    "staff.password": "Own password changed",
    "shift.open": "Shift opened",
    "shift.close": "Shift closed",
    "coupon.create": "Coupon created",
    "coupon.update": "Coupon edited",
    "coupon.delete": "Coupon deleted",
    "settings.update": "Settings changed",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal table; unknown keys pass through."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(literal[key], key)


def method_label(method: Column) -> Column:
    return lookup(METHOD_NAMES, F.coalesce(method, F.lit("unknown")))


def action_label(action: Column) -> Column:
    return lookup(ACTION_NAMES, action)


def share_pct(part: Column, whole: Column) -> Column:
    """Whole percent of a total, 0 when the total is 0 or missing."""
    ratio = F.round(part.cast("decimal(38,6)") * 100 / F.nullif(whole, F.lit(0)), 0)
    return F.coalesce(ratio, F.lit(0)).cast("int")


def late_class(minutes: Column) -> Column:
    return (
        F.when(minutes >= VERY_LATE_MINUTES, "very-late")
        .when(minutes >= LATE_MINUTES, "late")
        .otherwise("on-time")
    )


def age_text(minutes: Column) -> Column:
    return F.when(minutes < 1, F.lit("just now")).otherwise(F.concat(minutes.cast("string"), F.lit(" min ago")))


def stock_badge(tracked: Column, stock: Column, alert: Column) -> Column:
    return (
        F.when(~tracked, "not tracked")
        .when(stock <= 0, "out")
        .when(alert.isNotNull() & (stock <= alert), "low")
        .otherwise("ok")
    )


def cash_diff_label(difference: Column) -> Column:
    d = F.coalesce(difference, F.lit(0))
    return F.when(F.abs(d) < F.lit("0.005").cast("decimal(4,3)"), "Exact match").when(d < 0, "Short by").otherwise("Over by")


def big_unit(qty: Column, unit: Column) -> Column:
    """Kilograms / litres for a thousand grams / millilitres or more, else null."""
    big = F.when(unit == "g", F.lit("kg")).when(unit == "ml", F.lit("l"))
    return F.when((qty >= 1000) & big.isNotNull(), F.concat_ws(" ", plain_number(qty / 1000, 3), big))


def plain_number(c: Column, scale: int) -> Column:
    """A decimal rounded to ``scale`` places as text without trailing zeros."""
    text = F.round(c, scale).cast(f"decimal(38,{scale})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def coupon_state(active: Column, valid_from: Column, valid_to: Column, usage_limit: Column, uses: Column, today: Column) -> Column:
    return (
        F.when(~active, "off")
        .when(today > valid_to, "expired")
        .when(uses >= usage_limit, "used up")
        .when(today < valid_from, "scheduled")
        .otherwise("active")
    )


def coupon_offer(kind: Column, value: Column, max_discount: Column, min_bill: Column, buy: Column, get: Column, currency: str) -> Column:
    money = lambda c: F.concat(F.lit(currency), c.cast("decimal(12,2)").cast("string"))
    headline = (
        F.when(kind == "percent", F.concat(plain_number(value, 2), F.lit("% off")))
        .when(kind == "flat", F.concat(money(value), F.lit(" off")))
        .otherwise(F.concat(F.lit("Buy "), buy.cast("string"), F.lit(" get "), get.cast("string"), F.lit(" free")))
    )
    cap = F.when(max_discount.isNotNull(), F.concat(F.lit("up to "), money(max_discount)))
    floor = F.when(min_bill > 0, F.concat(F.lit("min bill "), money(min_bill)))
    return F.concat_ws(" · ", headline, cap, floor)


def coupon_validity(valid_from: Column, valid_to: Column) -> Column:
    day = lambda c: F.date_format(c, "d MMM yyyy")
    return (
        F.when(valid_from.isNull() & valid_to.isNull(), F.lit("Always"))
        .when(valid_from.isNull(), F.concat(F.lit("Until "), day(valid_to)))
        .when(valid_to.isNull(), F.concat(F.lit("From "), day(valid_from)))
        .otherwise(F.concat(day(valid_from), F.lit(" – "), day(valid_to)))
    )
