"""Searches, listings and pages.

Pages sort with a unique last key and cut with a limit, which Spark runs as a
top-k per partition; wide or nested columns are joined to the kept rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import clean
from tillworks.functions import timeutil as T

MAX_PAGE = 200


def clamp(n: int | None, default: int = 50, most: int = MAX_PAGE) -> int:
    return min(max(default if n is None else n, 1), most)


def order_matches(term: str | None) -> Column:
    """Phone contains, name contains (any case), id equals, or coupon code equals (any case)."""
    term = (term or "").strip()
    if not term:
        return F.lit(True)
    anywhere, whole = clean.like_any(term), term.replace("\\", "\\\\")
    return (
        F.coalesce(F.col("phone").like(anywhere), F.lit(False))
        | F.coalesce(F.col("customer_name").ilike(anywhere), F.lit(False))
        | (F.col("id").cast("string") == term)
        | F.coalesce(F.col("coupon_code").ilike(whole), F.lit(False))
    )


def audit_matches(category: str | None, term: str | None) -> Column:
    """Action of a category, and user or details containing the term or the entity equal to it."""
    category, term = (category or "").strip(), (term or "").strip()
    hit = F.lit(True)
    if category:
        hit = F.col("action").like(category.replace("\\", "\\\\") + ".%")
    if term:
        anywhere = clean.like_any(term)
        hit = hit & (
            F.coalesce(F.col("admin_username").ilike(anywhere), F.lit(False))
            | F.coalesce(F.col("entity_id") == term, F.lit(False))
            | F.col("details").ilike(anywhere)
        )
    return hit


def contains_text(term: str, *columns: str) -> Column:
    """Plain lower-case substring test on any of the columns; no wildcards."""
    needle = term.strip().lower()
    hit = F.lit(not needle)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return hit


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, most: int = MAX_PAGE) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(clamp(limit, most=most))


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """Rows of a filtered set and the pages they fill, at least one."""
    n = F.count("*")
    return df.agg(n.alias("total_count"), F.greatest(F.ceil(n / size), F.lit(1)).cast("bigint").alias("pages"))



def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def with_author(df: DataFrame, admins: DataFrame, key: str = "created_by", name: str = "author", missing: str | None = None) -> DataFrame:
    """Attaches a username; rows without an account keep null or the given label."""
    who = admins.select(F.col("id").alias(key), F.col("username").alias(name))
    out = df.join(who, key, "left")
    return out if missing is None else out.withColumn(name, F.coalesce(name, F.lit(missing)))


def orders_page(orders: DataFrame, admins: DataFrame, term: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    return with_author(page(orders.filter(order_matches(term)), newest_first(), limit, offset), admins)


def audit_page(audit: DataFrame, category: str | None = None, term: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(audit.filter(audit_matches(category, term)), newest_first(), limit, offset)


def pending_orders(orders: DataFrame, n: int = 50) -> DataFrame:
    return page(orders.filter(F.col("payment_status") == "pending"), newest_first(), n)


def orders_by_phone(orders: DataFrame, phone: str, n: int = 100) -> DataFrame:
    """Newest bills of one phone; fewer than six digits find nothing."""
    key = "".join(ch for ch in phone if ch.isdigit())
    hit = F.col("phone") == key if len(key) >= 6 else F.lit(False)
    return page(orders.filter(hit), newest_first(), n)


def newest_per_phone(orders: DataFrame, n: int = 100) -> DataFrame:
    """The same for all phones at once. Walk-ins are dropped before the window, and Spark
    keeps only each map task's first ``n`` per phone before the shuffle."""
    w = Window.partitionBy("phone").orderBy(*newest_first())
    return orders.filter("phone is not null").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def shifts_in_range(shifts: DataFrame, days: T.DayRange, n: int = 200) -> DataFrame:
    return page(shifts.filter(days.contains(F.col("opened_at"))), [F.desc("opened_at"), F.desc("id")], n)


def menu_listing(menu: DataFrame, include_inactive: bool = False) -> DataFrame:
    rows = menu if include_inactive else menu.filter("is_active")
    return rows.orderBy("category", "name", "id")


def menu_categories(menu: DataFrame) -> DataFrame:
    return menu.select("category").distinct()


def used_counts(ingredients: DataFrame, recipes: DataFrame) -> DataFrame:
    """Every ingredient with the number of recipes using it."""
    counts = recipes.groupBy("ingredient_id").agg(F.count("*").alias("used_count"))
    return ingredients.join(counts.withColumnRenamed("ingredient_id", "id"), "id", "left").withColumn("used_count", F.coalesce("used_count", F.lit(0)))


def ingredient_listing(ingredients: DataFrame, recipes: DataFrame) -> DataFrame:
    return used_counts(ingredients, recipes).orderBy(F.lower("name"), "id")


def low_stock(ingredients: DataFrame) -> DataFrame:
    """Tracked ingredients at or below their alert level (zero where none is set), empty ones first."""
    low = F.col("track_stock") & (F.col("stock") <= F.coalesce("low_stock_at", F.lit(0)))
    return ingredients.filter(low).orderBy((F.col("stock") <= 0).desc(), F.lower("name"), "id")


def items_by_order(items: DataFrame) -> DataFrame:
    """Per bill its lines as an ordered array. Meant for the bills of one page."""
    entry = F.struct("line_no", F.col("item_name").alias("name"), "price", "qty")
    packed = items.groupBy("order_id").agg(F.array_sort(F.collect_list(entry)).alias("_items"))
    return packed.select(
        F.col("order_id").alias("id"),
        F.transform("_items", lambda i: F.struct(i["name"].alias("name"), i["price"].alias("price"), i["qty"].alias("qty"))).alias("items"),
    )


def with_items(page_rows: DataFrame, items: DataFrame, empty: bool = False) -> DataFrame:
    """Attaches the ordered ``items`` array; bills without lines get null, or an empty array if asked."""
    out = page_rows.join(items_by_order(items), "id", "left")
    if empty:
        out = out.withColumn("items", F.coalesce("items", F.from_json(F.lit("[]"), "array<struct<name:string,price:decimal(10,2),qty:int>>")))
    return out


def items_text(items: Column) -> Column:
    """'2× Dosa, 1× Tea', null for a bill without lines."""
    return F.array_join(F.transform(items, lambda i: F.concat(i["qty"].cast("string"), F.lit("× "), i["name"])), ", ")
