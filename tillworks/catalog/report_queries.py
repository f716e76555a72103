"""Sales and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog.params import ALL_DAYS, ALL_DAYS_SQL, AS_OF, AS_OF_SQL, DAY, LOCAL
from tillworks.catalog.registry import query
from tillworks.operators.prefix import numbered_in_order
from tillworks.plans import reports as R

M, Q = "DECIMAL(24,2)", "DECIMAL(24,3)"
PAID = f"SELECT *, {LOCAL} AS local_at FROM pos_orders WHERE payment_status = 'paid' AND {ALL_DAYS_SQL}"


def cube(t):
    return R.order_cube(t.orders_between(ALL_DAYS), ALL_DAYS)


@query(
    "sales_summary",
    f"""SELECT count(*) FILTER (payment_status = 'paid') AS orders,
 CAST(coalesce(sum(total) FILTER (payment_status = 'paid'), 0) AS {M}) AS sales,
 CAST(coalesce(CAST((2 * CAST(100 * sum(total) FILTER (payment_status = 'paid') AS HUGEINT) + count(*) FILTER (payment_status = 'paid'))
   // (2 * count(*) FILTER (payment_status = 'paid')) AS DECIMAL(20,0)) / 100, 0) AS DECIMAL(12,2)) AS avg_bill,
 count(*) FILTER (payment_status = 'pending') AS pending_orders, CAST(coalesce(sum(total) FILTER (payment_status = 'pending'), 0) AS {M}) AS pending_total,
 count(*) FILTER (payment_status = 'cancelled') AS cancelled_orders, CAST(coalesce(sum(total) FILTER (payment_status = 'cancelled'), 0) AS {M}) AS cancelled_total
 FROM pos_orders WHERE {ALL_DAYS_SQL}""",
)
def sales_summary(t):
    return R.sales_summary(cube(t))


@query(
    "sales_by_method",
    f"SELECT coalesce(payment_method, 'unknown') AS method, count(*) AS orders, CAST(sum(total) AS {M}) AS total FROM p GROUP BY 1",
    p=PAID,
)
def sales_by_method(t):
    return R.sales_by_method(cube(t))


BY_DAY = f"""SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, coalesce(n, 0) AS orders, CAST(coalesce(s, 0) AS {M}) AS total
 FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL '1' DAY) g(d)
 LEFT JOIN (SELECT CAST(local_at AS DATE) AS dd, count(*) AS n, sum(total) AS s FROM p GROUP BY 1) x ON dd = CAST(d AS DATE)"""
BY_HOUR = f"""SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS orders, CAST(coalesce(s, 0) AS {M}) AS total FROM range(24) g(h)
 LEFT JOIN (SELECT hour(local_at) AS hr, count(*) AS n, sum(total) AS s FROM p GROUP BY 1) x ON hr = h"""


@query("sales_by_day", BY_DAY, p=PAID)
def sales_by_day(t):
    return R.sales_by_day(cube(t), ALL_DAYS)


@query("sales_by_hour", BY_HOUR, p=PAID)
def sales_by_hour(t):
    return R.sales_by_hour(cube(t))


@query(
    "calendar_spine_join",
    f"""SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, coalesce(n, 0) AS orders, CAST(coalesce(s, 0) AS {M}) AS total
 FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL '1' DAY) g(d)
 LEFT JOIN (SELECT {DAY} AS dd, count(*) AS n, sum(total) AS s FROM pos_orders WHERE {ALL_DAYS_SQL} AND payment_status = 'cancelled' GROUP BY 1) x ON dd = CAST(d AS DATE)""",
)
def calendar_spine_join(t):
    gone = cube(t).filter(F.col("payment_status") == "cancelled").groupBy("day").agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))
    return R.zero_filled(ALL_DAYS.days(t.spark), gone, "day")


@query("busy_hours", "SELECT * FROM h WHERE hour BETWEEN (SELECT min(hour) FROM h WHERE orders > 0) AND (SELECT max(hour) FROM h WHERE orders > 0)", p=PAID, h=BY_HOUR)
def busy_hours(t):
    return R.busy_hours(R.sales_by_hour(cube(t)))


@query(
    "sales_by_staff",
    f"""SELECT created_by, coalesce(username, '—') AS username, orders, total FROM
 (SELECT created_by, count(*) AS orders, CAST(sum(total) AS {M}) AS total FROM p GROUP BY 1) x LEFT JOIN pos_admins a ON a.id = created_by""",
    p=PAID,
)
def sales_by_staff(t):
    return R.sales_by_staff(cube(t), t.admins)


TOP = f"""SELECT item_name AS name, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(qty * i.price) AS {M}) AS revenue
 FROM pos_order_items i JOIN p ON p.id = i.order_id GROUP BY 1 ORDER BY revenue DESC, qty DESC, name LIMIT 10"""


def sold(t):
    paid = t.orders_between(ALL_DAYS).filter("payment_status = 'paid'")
    return R.with_menu(R.sold_quantities(paid, t.order_lines), t.menu)


@query("top_items", TOP, p=PAID)
def top_items(t):
    return R.top_items(sold(t))


@query(
    "share_pct",
    """SELECT 'method' AS kind, method AS label, CAST((200 * total + whole) // (2 * whole) AS INTEGER) AS share FROM (SELECT method, CAST(total * 100 AS HUGEINT) AS total, sum(CAST(total * 100 AS HUGEINT)) OVER () AS whole FROM m)
 UNION ALL SELECT 'item', name, CAST((200 * revenue + whole) // (2 * whole) AS INTEGER) FROM (SELECT name, CAST(revenue * 100 AS HUGEINT) AS revenue, max(CAST(revenue * 100 AS HUGEINT)) OVER () AS whole FROM i)""",
    p=PAID,
    m="SELECT coalesce(payment_method, 'unknown') AS method, sum(total) AS total FROM p GROUP BY 1",
    i=TOP,
)
def share_pct(t):
    by_method = R.with_share(R.sales_by_method(cube(t)), "total").select(F.lit("method").alias("kind"), F.col("method").alias("label"), "share")
    by_item = R.with_share(R.top_items(sold(t)), "revenue", "max").select(F.lit("item").alias("kind"), F.col("name").alias("label"), "share")
    return by_method.unionByName(by_item)


SECTIONS = dict(
    p=PAID,
    o=f"SELECT * FROM pos_orders WHERE {ALL_DAYS_SQL}",
    m=f"SELECT coalesce(payment_method, 'unknown') AS method, count(*) AS orders, CAST(sum(total) AS {M}) AS total FROM p GROUP BY 1",
    d=BY_DAY,
    h=BY_HOUR,
    i=TOP,
    s=f"SELECT created_by, coalesce(username, '—') AS username, orders, total FROM (SELECT created_by, count(*) AS orders, CAST(sum(total) AS {M}) AS total FROM p GROUP BY 1) x LEFT JOIN pos_admins a ON a.id = created_by",
    r=f"""SELECT 'paid' AS section, 1 AS rank, 'sales' AS label, count(*) AS orders, CAST(coalesce(sum(total), 0) AS {M}) AS total FROM p
 UNION ALL SELECT 'average', 1, 'avg', count(*), CAST(coalesce(CAST((2 * CAST(100 * sum(total) AS HUGEINT) + count(*)) // (2 * count(*)) AS DECIMAL(20,0)) / 100, 0) AS {M}) FROM p
 UNION ALL SELECT 'pending', 1, 'pending', count(*), CAST(coalesce(sum(total), 0) AS {M}) FROM o WHERE payment_status = 'pending'
 UNION ALL SELECT 'cancelled', 1, 'cancelled', count(*), CAST(coalesce(sum(total), 0) AS {M}) FROM o WHERE payment_status = 'cancelled'
 UNION ALL SELECT 'by_method', row_number() OVER (ORDER BY total DESC, method), method, orders, total FROM m
 UNION ALL SELECT 'by_day', row_number() OVER (ORDER BY day), day, orders, total FROM d
 UNION ALL SELECT 'by_hour', row_number() OVER (ORDER BY hour), CAST(hour AS VARCHAR), orders, total FROM h
 UNION ALL SELECT 'top_items', row_number() OVER (ORDER BY revenue DESC, qty DESC, name), name, qty, revenue FROM i
 UNION ALL SELECT 'by_staff', row_number() OVER (ORDER BY total DESC, username, created_by NULLS FIRST), username, orders, total FROM s""",
)


@query("sales_report", f"SELECT section, CAST(rank AS INTEGER) AS rank, label, CAST(orders AS BIGINT) AS orders, CAST(total AS {M}) AS total FROM r", **SECTIONS)
def sales_report(t):
    return R.sales_report(t.orders_between(ALL_DAYS), t.order_lines, t.menu, t.admins, ALL_DAYS)


@query(
    "report_json",
    """SELECT section, '[' || string_agg('{"label":"' || label || '","orders":' || CAST(orders AS VARCHAR) || ',"total":' || CAST(total AS VARCHAR) || '}', ',' ORDER BY rank) || ']' AS document FROM r GROUP BY section""",
    **SECTIONS,
)
def report_json(t):
    return R.report_document(R.sales_report(t.orders_between(ALL_DAYS), t.order_lines, t.menu, t.admins, ALL_DAYS))


USAGE = dict(
    o=f"SELECT id, {DAY} AS day FROM pos_orders WHERE payment_status <> 'cancelled' AND {ALL_DAYS_SQL}",
    u="""SELECT o.day, g.name, g.unit, sum(r.qty * i.qty) AS total FROM pos_order_items i JOIN o ON o.id = i.order_id
 JOIN pos_menu_item_ingredients r ON r.menu_item_id = i.menu_item_id JOIN pos_ingredients g ON g.id = r.ingredient_id GROUP BY 1, 2, 3""",
)
USAGE_ARGS = lambda t: (t.orders_between(ALL_DAYS), t.order_lines, t.recipes, t.ingredients, ALL_DAYS)


@query("ingredient_usage", f"SELECT CAST(day AS VARCHAR) AS day, name, unit, CAST(sum(total) AS {Q}) AS total FROM u GROUP BY GROUPING SETS ((day, name, unit), (name, unit))", **USAGE)
def ingredient_usage(t):
    return R.usage_both_shapes(*USAGE_ARGS(t))


@query(
    "usage_coverage",
    """SELECT n AS order_count, w AS orders_with_ingredients, n - w AS missing FROM (SELECT count(*) AS n,
 count(*) FILTER (id IN (SELECT i.order_id FROM pos_order_items i JOIN pos_menu_item_ingredients r ON r.menu_item_id = i.menu_item_id)) AS w FROM o)""",
    o=USAGE["o"],
)
def usage_coverage(t):
    return R.usage_coverage(t.orders_between(ALL_DAYS), t.order_lines, t.recipes, ALL_DAYS)


@query("usage_report", f"SELECT CAST(row_number() OVER (ORDER BY lower(name)) AS INTEGER) AS pos, name, unit, total FROM (SELECT name, unit, CAST(sum(total) AS {Q}) AS total FROM u GROUP BY 1, 2)", **USAGE)
def usage_report(t):
    rows = R.usage_from_snapshots(t.orders_between(ALL_DAYS), _snapshots(t), ALL_DAYS)
    return numbered_in_order(rows, [F.lower("name"), F.col("name"), F.col("unit")], "pos").select(F.col("pos").cast("int").alias("pos"), "name", "unit", "total")


def _snapshots(t):
    from tillworks.plans.bills import recipe_explosion

    return recipe_explosion(t.order_lines, t.recipes, t.ingredients)


@query("unit_rollup", f"""SELECT name, unit, total, CASE WHEN unit = 'g' AND total >= 1000 THEN rtrim(rtrim(CAST(CAST(total * 1000 AS HUGEINT) // 1000000 AS VARCHAR) || '.' || lpad(CAST((CAST(total * 1000 AS HUGEINT) // 1000) % 1000 AS VARCHAR), 3, '0'), '0'), '.') || ' kg'
 WHEN unit = 'ml' AND total >= 1000 THEN rtrim(rtrim(CAST(CAST(total * 1000 AS HUGEINT) // 1000000 AS VARCHAR) || '.' || lpad(CAST((CAST(total * 1000 AS HUGEINT) // 1000) % 1000 AS VARCHAR), 3, '0'), '0'), '.') || ' l' END AS big
 FROM (SELECT name, unit, CAST(sum(total) AS {Q}) AS total FROM u GROUP BY 1, 2)""", **USAGE)
def unit_rollup(t):
    from tillworks.functions.labels import big_unit

    usage = R.ingredient_usage(*USAGE_ARGS(t))
    return usage.withColumn("big", big_unit(F.col("total"), F.col("unit")))


@query(
    "favourites",
    f"""SELECT i.menu_item_id, CAST(sum(i.qty) AS BIGINT) AS qty FROM pos_order_items i JOIN pos_orders o ON o.id = i.order_id JOIN pos_menu_items m ON m.id = i.menu_item_id AND m.is_active
 WHERE o.payment_status = 'paid' AND o.created_at > {AS_OF_SQL} - INTERVAL '7' DAY GROUP BY 1 ORDER BY qty DESC, menu_item_id LIMIT 6""",
)
def favourites(t):
    return R.favourites(t.orders_since(AS_OF - R.LIKED), t.order_lines, t.menu, AS_OF)


@query("usage_csv_export", f"SELECT CAST(day AS VARCHAR) AS day, name, CAST(CAST(sum(total) AS {Q}) AS VARCHAR) AS total, unit FROM u GROUP BY day, name, unit", **USAGE)
def usage_csv_export(t):
    """The daily usage CSV, written by the executors and read back as text."""
    from tillworks.sources.sinks import write_usage_csv
    from tillworks.streaming.feeds import new_run

    usage = R.ingredient_usage(*USAGE_ARGS(t), by_day=True)
    path = write_usage_csv(usage, new_run(t.spark, "usage-csv"), ALL_DAYS)
    reader = t.spark.read.schema("day string, name string, total string, unit string").option("header", True).option("escape", '"')
    return reader.csv(path)
