"""Sales and ingredient-usage reports.

The sales report reads the orders once: they are reduced to a small cube keyed by
local day, hour, payment state, method and author, which is written to the shared
folder, and every section is a further aggregate of that cube.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import labels
from tillworks.functions import timeutil as T

MONEY_SUM = "decimal(24,2)"
QTY_SUM = "decimal(24,3)"
LIKED = timedelta(days=7)  # how far back favourites look
CUBE_KEYS = ["day", "hour", "payment_status", "payment_method", "created_by"]


def money_sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM)


def order_cube(orders: DataFrame, days: T.DayRange) -> DataFrame:
    """Count and total of orders in a local range per day, hour, state, method and author."""
    ts = F.col("created_at")
    return (
        orders.filter(days.contains(ts))
        .select(T.local_day(ts).alias("day"), T.local_hour(ts).alias("hour"), "payment_status", "payment_method", "created_by", "total")
        .groupBy(*CUBE_KEYS)
        .agg(F.count("*").alias("orders"), F.sum("total").cast(MONEY_SUM).alias("total"))
    )


def paid(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("payment_status") == "paid")


def average(total: Column, n: Column) -> Column:
    """Two-decimal average, rounded half away from zero; 0 for no rows."""
    exact = total.cast("decimal(38,10)") / F.nullif(n, F.lit(0)).cast("decimal(15,0)")
    return F.coalesce(F.round(exact, 2), F.lit(0)).cast("decimal(12,2)")


def sales_summary(cube: DataFrame) -> DataFrame:
    def pick(state: str) -> tuple[Column, Column]:
        hit = F.col("payment_status") == state
        return F.coalesce(F.sum(F.when(hit, F.col("orders"))), F.lit(0)), money_sum(F.when(hit, F.col("total")))

    (n_paid, s_paid), (n_wait, s_wait), (n_gone, s_gone) = pick("paid"), pick("pending"), pick("cancelled")
    return cube.agg(
        n_paid.alias("orders"),
        s_paid.alias("sales"),
        average(s_paid, n_paid).alias("avg_bill"),
        n_wait.alias("pending_orders"),
        s_wait.alias("pending_total"),
        n_gone.alias("cancelled_orders"),
        s_gone.alias("cancelled_total"),
    )


def _sales_by(cube: DataFrame, *keys: Column | str) -> DataFrame:
    return paid(cube).groupBy(*keys).agg(F.sum("orders").alias("orders"), money_sum("total").alias("total"))


def per_method(cube: DataFrame) -> DataFrame:
    return _sales_by(cube, F.coalesce("payment_method", F.lit("unknown")).alias("method"))


def sales_by_method(cube: DataFrame) -> DataFrame:
    return per_method(cube).orderBy(F.desc("total"), "method")


def zero_filled(spine: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every spine key once, with zeros where nothing was found."""
    return spine.join(found, key, "left").select(
        key, F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0)).cast(MONEY_SUM).alias("total")
    )


def per_day(cube: DataFrame, days: T.DayRange) -> DataFrame:
    return zero_filled(days.days(cube.sparkSession), _sales_by(cube, "day"), "day")


def sales_by_day(cube: DataFrame, days: T.DayRange) -> DataFrame:
    return per_day(cube, days).orderBy("day")


def per_hour(cube: DataFrame) -> DataFrame:
    hours = cube.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return zero_filled(hours, _sales_by(cube, "hour"), "hour")


def sales_by_hour(cube: DataFrame) -> DataFrame:
    return per_hour(cube).orderBy("hour")


def per_author(cube: DataFrame, admins: DataFrame) -> DataFrame:
    """Paid sales per author; authors without an account row share the ``—`` label but stay separate rows."""
    names = admins.select(F.col("id").alias("created_by"), "username")
    return _sales_by(cube, "created_by").join(names, "created_by", "left").select(
        "created_by", F.coalesce("username", F.lit("—")).alias("username"), "orders", "total"
    )


def sales_by_staff(cube: DataFrame, admins: DataFrame) -> DataFrame:
    return per_author(cube, admins).orderBy(F.desc("total"), "username")


def busy_hours(by_hour: DataFrame) -> DataFrame:
    """The inclusive span between the first and the last hour with sales (24 input rows)."""
    everything = Window.partitionBy()
    active = F.when(F.col("orders") > 0, F.col("hour"))
    return (
        by_hour.withColumn("_lo", F.min(active).over(everything))
        .withColumn("_hi", F.max(active).over(everything))
        .filter(F.col("hour").between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def with_share(rows: DataFrame, amount: str, whole: str = "sum") -> DataFrame:
    """Adds ``share``: percent of the column's sum (or of its maximum). For report-sized frames only."""
    total = getattr(F, whole)(amount).over(Window.partitionBy())
    return rows.withColumn("share", labels.share_pct(F.col(amount), total))


def sold_quantities(orders: DataFrame, lines: DataFrame, *by: Column | str) -> DataFrame:
    """Quantity sold per menu item (and per ``by`` columns of the orders).

    Lines are summed before any dimension is joined, with Spark's map-side partial
    sums, so a best seller does not travel line by line. Snapshot name and price
    columns are kept as keys when the lines carry them.
    """
    keys = [c for c in ("menu_item_id", "item_name", "price") if c in lines.columns]
    picked = orders.select(F.col("id").alias("order_id"), *by)
    extra = [c for c in picked.columns if c != "order_id"]
    return lines.join(picked, "order_id").groupBy(*extra, *keys).agg(F.sum("qty").alias("qty"))


def with_menu(sold: DataFrame, menu: DataFrame) -> DataFrame:
    return sold.join(menu.select(F.col("id").alias("menu_item_id"), F.col("name").alias("item_name"), "price"), "menu_item_id")


def top_items(sold: DataFrame, n: int = 10) -> DataFrame:
    """Best sellers by item name: revenue before discounts, then quantity, then name."""
    return (
        sold.groupBy(F.col("item_name").alias("name"))
        .agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).cast(MONEY_SUM).alias("revenue"))
        .orderBy(F.desc("revenue"), F.desc("qty"), "name")
        .limit(n)
    )


def favourites(orders: DataFrame, lines: DataFrame, menu: DataFrame, as_of, n: int = 6) -> DataFrame:
    """Most sold active items among paid bills of the last days."""
    recent = orders.filter((F.col("payment_status") == "paid") & (F.col("created_at") > T.instant(as_of - LIKED)))
    active = menu.filter("is_active").select(F.col("id").alias("menu_item_id"))
    sold = sold_quantities(recent, lines.select("order_id", "menu_item_id", "qty"))
    return sold.join(active, "menu_item_id", "left_semi").orderBy(F.desc("qty"), "menu_item_id").limit(n)


def sales_report(orders: DataFrame, lines: DataFrame, menu: DataFrame, admins: DataFrame, days: T.DayRange) -> DataFrame:
    """All sections as rows: (section, rank, label, orders, total)."""
    # Left lazy, every section would push its own filter below the cube and scan the orders again.
    cube = stage_table(order_cube(orders, days))
    summary = sales_summary(cube)
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    paid_orders = orders.filter(days.contains(F.col("created_at")) & (F.col("payment_status") == "paid"))
    top = with_menu(sold_quantities(paid_orders, lines), menu) if "item_name" not in lines.columns else sold_quantities(paid_orders, lines)

    def section(df: DataFrame, name: str, label: Column, orders_col: str = "orders", total_col: str = "total") -> DataFrame:
        return df.select(
            F.lit(name).alias("section"),
            F.col("rank").cast("int").alias("rank"),
            label.cast("string").alias("label"),
            F.col(orders_col).cast("bigint").alias("orders"),
            F.col(total_col).cast(MONEY_SUM).alias("total"),
        )

    one = summary.withColumn("rank", F.lit(1))
    parts = [
        section(one, "paid", F.lit("sales"), "orders", "sales"),
        section(one, "average", F.lit("avg"), "orders", "avg_bill"),
        section(one, "pending", F.lit("pending"), "pending_orders", "pending_total"),
        section(one, "cancelled", F.lit("cancelled"), "cancelled_orders", "cancelled_total"),
        section(ranked(per_method(cube), F.desc("total"), "method"), "by_method", F.col("method")),
        section(ranked(per_day(cube, days), "day"), "by_day", F.col("day")),
        section(ranked(per_hour(cube), "hour"), "by_hour", F.col("hour")),
        section(ranked(top_items(top), F.desc("revenue"), F.desc("qty"), "name"), "top_items", F.col("name"), "qty", "revenue"),
        section(ranked(per_author(cube, admins), F.desc("total"), "username", "created_by"), "by_staff", F.col("username")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_document(sections: DataFrame) -> DataFrame:
    """One JSON text per section of a report, entries in rank order."""
    entry = F.struct("rank", "label", "orders", "total")
    return sections.groupBy("section").agg(
        F.to_json(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["label"].alias("label"), e["orders"].alias("orders"), e["total"].alias("total"))),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )


def billed_orders(orders: DataFrame, days: T.DayRange) -> DataFrame:
    """Orders of a range that count for usage: everything but the cancelled ones."""
    return orders.filter((F.col("payment_status") != "cancelled") & days.contains(F.col("created_at")))


def ingredient_usage(orders: DataFrame, lines: DataFrame, recipes: DataFrame, ingredients: DataFrame, days: T.DayRange, by_day: bool = False) -> DataFrame:
    """Ingredient totals of a range, from sold quantities times the recipe.

    Quantities are summed per day and menu item before the recipe multiplies them.
    """
    day = [T.local_day(F.col("created_at")).alias("day")] if by_day else []
    sold = sold_quantities(billed_orders(orders, days), lines.select("order_id", "menu_item_id", "qty"), *day)
    parts = ingredients.select(F.col("id").alias("ingredient_id"), "name", "unit")
    need = sold.join(recipes.withColumnRenamed("qty", "per_unit"), "menu_item_id").join(parts, "ingredient_id")
    return need.groupBy(*(["day"] if by_day else []), "name", "unit").agg(F.sum(F.col("per_unit") * F.col("qty")).cast(QTY_SUM).alias("total"))


def usage_from_snapshots(orders: DataFrame, order_ingredients: DataFrame, days: T.DayRange, by_day: bool = False) -> DataFrame:
    """The same report from ingredient rows frozen at billing time."""
    picked = billed_orders(orders, days).select(F.col("id").alias("order_id"), T.local_day(F.col("created_at")).alias("day"))
    keys = (["day"] if by_day else []) + ["ingredient_name", "unit"]
    out = order_ingredients.join(picked, "order_id").groupBy(*keys).agg(F.sum("qty").cast(QTY_SUM).alias("total"))
    return out.withColumnRenamed("ingredient_name", "name")


def usage_both_shapes(orders: DataFrame, lines: DataFrame, recipes: DataFrame, ingredients: DataFrame, days: T.DayRange) -> DataFrame:
    """Per-day and whole-range usage in one pass: the per-day rows are few and are rolled up again."""
    daily = ingredient_usage(orders, lines, recipes, ingredients, days, by_day=True)
    return (
        daily.groupingSets([["day", "name", "unit"], ["name", "unit"]], "day", "name", "unit")
        .agg(F.sum("total").cast(QTY_SUM).alias("total"))
        .orderBy(F.col("day").desc_nulls_last(), F.lower("name"))
    )


def usage_coverage(orders: DataFrame, lines: DataFrame, recipes: DataFrame, days: T.DayRange) -> DataFrame:
    """Orders of the range, those with any ingredient data, and the difference."""
    billed = billed_orders(orders, days).select(F.col("id").alias("order_id"))
    covered = lines.join(recipes, "menu_item_id", "left_semi").select("order_id", F.lit(1).alias("hit")).dropDuplicates(["order_id"])
    return (
        billed.join(covered, "order_id", "left")
        .agg(F.count("*").alias("order_count"), F.count("hit").alias("orders_with_ingredients"))
        .withColumn("missing", F.col("order_count") - F.col("orders_with_ingredients"))
    )
