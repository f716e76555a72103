"""Scans, payloads and column-level rules over whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tillworks.catalog.params import AS_OF, AS_OF_SQL, EVENTS_AS_OF, EVENTS_AS_OF_SQL, LOCAL, ONE_YEAR, ONE_YEAR_SQL
from tillworks.catalog.registry import query
from tillworks.functions import access, clean, hours, labels
from tillworks.functions import timeutil as T
from tillworks.plans.bills import recipe_explosion
from tillworks.sources import payloads

SCANS = {
    "admins": ("admins", "pos_admins"),
    "menu_items": ("menu", "pos_menu_items"),
    "customers": ("customers", "pos_customers"),
    "orders": ("orders", "pos_orders"),
    "ingredients": ("ingredients", "pos_ingredients"),
    "menu_item_ingredients": ("recipes", "pos_menu_item_ingredients"),
    "login_attempts": ("logins", "pos_login_attempts"),
    "admin_sessions": ("sessions", "pos_sessions"),
    "audit_log": ("audit", "pos_audit_log"),
    "stock_movements": ("stock_events", "pos_stock_events"),
    "shifts": ("shifts", "pos_shifts"),
    "settings": ("settings", "pos_settings"),
}
for _name, (_attr, _view) in SCANS.items():
    query(f"scan_{_name}", f"SELECT * FROM {_view}")(partial(lambda attr, t: getattr(t, attr), _attr))

query("scan_order_items", "SELECT * FROM pos_order_items")(lambda t: t.numbered_items())
query(
    "scan_order_item_ingredients",
    """SELECT i.order_id, i.line_no, g.id AS ingredient_id, g.name AS ingredient_name, g.unit, CAST(r.qty * i.qty AS DECIMAL(14,3)) AS qty FROM pos_order_items i
 JOIN pos_menu_item_ingredients r ON r.menu_item_id = i.menu_item_id JOIN pos_ingredients g ON g.id = r.ingredient_id""",
)(lambda t: recipe_explosion(t.numbered_items(), t.recipes, t.ingredients).select("order_id", "line_no", "ingredient_id", "ingredient_name", "unit", "qty"))
query("scan_coupons", "SELECT * REPLACE (array_to_string(item_ids, ',') AS item_ids, array_to_string(categories, ',') AS categories, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to) FROM pos_coupons")(
    lambda t: t.coupons.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ",")).withColumn("categories", F.array_join("categories", ","))
)


@query("bill_payload_explode", "SELECT * FROM pos_bill_lines")
def bill_payload_explode(t):
    return payloads.explode_bill_items(t.bills)


def recipe_payloads(t):
    """Staged recipe edits, one per menu item; some hold a zero quantity or no id, some are not a list."""
    k = F.col("p_partkey")
    line = lambda ing, qty: F.concat(F.lit('{"ingredient_id":'), ing, F.lit(',"qty":'), qty, F.lit("}"))
    first = line((k % 50).cast("string"), ((k % 7).cast("string")))
    second = line(F.when(k % 23 == 0, F.lit("null")).otherwise((k % 13 + 60).cast("string")), F.lit("2.5"))
    third = line((k % 50).cast("string"), F.lit("1.125"))
    text = F.when(k % 29 == 0, F.lit('{"ingredient_id":1}')).otherwise(F.concat(F.lit("["), F.concat_ws(",", first, second, third), F.lit("]")))
    return t.raw("part").select(k.alias("menu_item_id"), text.alias("items"))


RECIPE_PAYLOADS = """SELECT k AS menu_item_id, CASE WHEN k % 29 = 0 THEN '{"ingredient_id":1}' ELSE '[{"ingredient_id":' || CAST(k % 50 AS VARCHAR) || ',"qty":' || CAST(k % 7 AS VARCHAR) || '},{"ingredient_id":'
 || CASE WHEN k % 23 = 0 THEN 'null' ELSE CAST(k % 13 + 60 AS VARCHAR) END || ',"qty":2.5},{"ingredient_id":' || CAST(k % 50 AS VARCHAR) || ',"qty":1.125}]' END AS items FROM (SELECT p_partkey AS k FROM part)"""
RECIPE_LINES = """SELECT menu_item_id, CAST(json_extract_string(items, '$[' || CAST(j AS VARCHAR) || '].ingredient_id') AS BIGINT) AS ingredient_id,
 CAST(json_extract_string(items, '$[' || CAST(j AS VARCHAR) || '].qty') AS DECIMAL(12,3)) AS qty FROM rp, range(3) g(j) WHERE json_type(items) = 'ARRAY'"""
RECIPE_GOOD = "SELECT * FROM rl WHERE menu_item_id NOT IN (SELECT menu_item_id FROM rl WHERE ingredient_id IS NULL OR qty <= 0)"


@query("recipe_payload_explode", "SELECT * FROM rg", rp=RECIPE_PAYLOADS, rl=RECIPE_LINES, rg=RECIPE_GOOD)
def recipe_payload_explode(t):
    return payloads.explode_recipe_items(recipe_payloads(t))


@query(
    "recipe_line_merge",
    "SELECT rg.menu_item_id, rg.ingredient_id, CAST(sum(rg.qty) AS DECIMAL(12,3)) AS qty FROM rg JOIN pos_ingredients i ON i.id = rg.ingredient_id GROUP BY 1, 2",
    rp=RECIPE_PAYLOADS,
    rl=RECIPE_LINES,
    rg=RECIPE_GOOD,
)
def recipe_line_merge(t):
    from tillworks.operators.maintain import merge_recipe_lines

    return merge_recipe_lines(payloads.explode_recipe_items(recipe_payloads(t)), t.ingredients)


@query(
    "id_list_payload",
    """SELECT k AS id, CASE WHEN k % 5 < k % 3 + 5 THEN CAST(k % 5 AS VARCHAR) || ',' || CAST(k % 3 + 5 AS VARCHAR) END AS item_ids,
 CASE WHEN k % 4 = 0 THEN 'Drinks' ELSE 'Drinks,Food ' || CAST(k % 4 AS VARCHAR) END AS categories FROM (SELECT p_partkey AS k FROM part)""",
)
def id_list_payload(t):
    k = F.col("p_partkey")
    ids = F.concat(F.lit("["), (k % 3 + 5).cast("string"), F.lit(","), (k % 5).cast("string"), F.lit(","), (k % 5).cast("string"), F.lit("]"))
    food = F.when(k % 4 == 0, F.lit('"  "')).otherwise(F.concat(F.lit('" Food '), (k % 4).cast("string"), F.lit(' "')))
    cats = F.concat(F.lit('["Drinks ",'), food, F.lit(',"Drinks"]'))
    return t.raw("part").select(
        k.alias("id"),
        F.array_join(payloads.id_list(ids).cast("array<string>"), ",").alias("item_ids"),
        F.array_join(payloads.text_list(cats), ",").alias("categories"),
    )


PHONES = "SELECT id, phone AS raw, nullif(regexp_replace(coalesce(phone, ''), '\\D', '', 'g'), '') AS phone FROM pos_bills"


@query("phone_normalise", "SELECT * FROM ph", ph=PHONES)
def phone_normalise(t):
    return t.bills.select("id", F.col("phone").alias("raw"), clean.digits(F.col("phone")).alias("phone"))


@query("phone_valid", "SELECT id, phone IS NULL OR regexp_full_match(phone, '[0-9]{10}') AS bill_ok, coalesce(length(phone) >= 6, false) AS lookup_ok FROM ph", ph=PHONES)
def phone_valid(t):
    phone = clean.digits(F.col("phone"))
    return t.bills.select("id", clean.phone_ok(phone).alias("bill_ok"), clean.lookup_phone_ok(phone).alias("lookup_ok"))


@query(
    "text_clean",
    """SELECT id, nullif(trim(customer_name), '') AS name, coalesce(nullif(trim(customer_name), ''), 'General') AS category, lower(trim(coalesce(payment_method, 'cash'))) AS method,
 lower(trim(coalesce(customer_name, ''))) AS username, upper(trim(coalesce(coupon_code, ''))) AS code FROM pos_bills""",
)
def text_clean(t):
    return t.bills.select(
        "id",
        clean.blank_to_null(F.col("customer_name")).alias("name"),
        clean.category_or_default(F.col("customer_name")).alias("category"),
        clean.payment_method(F.col("payment_method")).alias("method"),
        clean.username_key(F.col("customer_name")).alias("username"),
        clean.coupon_code_key(F.col("coupon_code")).alias("code"),
    )


@query("local_day_hour", f"SELECT id, CAST(CAST({LOCAL} AS DATE) AS VARCHAR) AS day, CAST(hour({LOCAL}) AS INTEGER) AS hour FROM pos_orders")
def local_day_hour(t):
    ts = F.col("created_at")
    return t.orders.select("id", T.local_day(ts).alias("day"), T.local_hour(ts).alias("hour"))


@query("local_range_filter", f"SELECT id, created_at, total FROM pos_orders WHERE {ONE_YEAR_SQL}")
def local_range_filter(t):
    return t.orders_between(ONE_YEAR).select("id", "created_at", "total")


@query(
    "range_presets",
    f"""SELECT preset, CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS last, count(day) AS orders, CAST(coalesce(sum(total), 0) AS DECIMAL(24,2)) AS total FROM (VALUES
 ('today', DATE '1998-07-01', DATE '1998-07-01'), ('yesterday', DATE '1998-06-30', DATE '1998-06-30'), ('7', DATE '1998-06-25', DATE '1998-07-01'),
 ('30', DATE '1998-06-02', DATE '1998-07-01'), ('month', DATE '1998-07-01', DATE '1998-07-01')) v(preset, a, b)
 LEFT JOIN (SELECT CAST({LOCAL} AS DATE) AS day, total FROM pos_orders) o ON day BETWEEN a AND b GROUP BY 1, 2, 3""",
)
def range_presets(t):
    presets = T.preset_ranges(AS_OF)
    hits = F.array_compact(
        F.array(*[F.when(r.contains(F.col("created_at")), F.lit(name)) for name, r in presets.items()])
    )
    whole = T.DayRange(min(r.first for r in presets.values()), max(r.last for r in presets.values()))
    found = t.orders_between(whole).select(F.explode(hits).alias("preset"), "total").groupBy("preset").agg(F.count("*").alias("n"), F.sum("total").alias("s"))
    spine = t.spark.createDataFrame([(n, r.first, r.last) for n, r in presets.items()], "preset string, first date, last date")
    return spine.join(found, "preset", "left").select(
        "preset", "first", "last", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("s", F.lit(0)).cast("decimal(24,2)").alias("total")
    )


@query(
    "order_search",
    "SELECT id, phone, customer_name FROM pos_orders WHERE phone LIKE '%0042%' OR customer_name ILIKE '%0042%' OR CAST(id AS VARCHAR) = '0042' OR CAST(coupon_id AS VARCHAR) ILIKE '0042' "
    "UNION ALL SELECT id, phone, customer_name FROM pos_orders WHERE phone LIKE '%er 7_%' OR customer_name ILIKE '%er 7_%' OR CAST(id AS VARCHAR) = 'er 7_'",
)
def order_search(t):
    from tillworks.operators.pages import order_matches

    orders = t.orders.withColumn("coupon_code", F.col("coupon_id").cast("string"))
    cols = ["id", "phone", "customer_name"]
    return orders.filter(order_matches("0042")).select(cols).unionByName(orders.filter(order_matches("er 7_")).select(cols))


@query(
    "audit_search",
    """SELECT id, action, entity_id FROM pos_audit_log WHERE action LIKE 'order.%' AND (admin_username ILIKE '%FF1%' OR entity_id = 'FF1' OR details ILIKE '%FF1%')
 UNION ALL SELECT id, action, entity_id FROM pos_audit_log WHERE (admin_username ILIKE '%"k": 7%' OR entity_id = '"k": 7' OR details ILIKE '%"k": 7%')""",
)
def audit_search(t):
    from tillworks.operators.pages import audit_matches

    cols = ["id", "action", "entity_id"]
    return t.audit.filter(audit_matches("order", "FF1")).select(cols).unionByName(t.audit.filter(audit_matches(None, '"k": 7')).select(cols))


@query("text_filter", "SELECT id, name, category FROM pos_menu_items WHERE (contains(lower(name), 'red') OR contains(lower(category), 'red')) AND category = 'ECONOMY'")
def text_filter(t):
    from tillworks.operators.pages import contains_text

    return t.menu.filter(contains_text("Red ", "name", "category") & (F.col("category") == "ECONOMY")).select("id", "name", "category")


WINDOW_SQL = """CASE WHEN a.role = 'super' OR a.login_from IS NULL OR a.login_to IS NULL OR a.login_from = a.login_to THEN true
 WHEN a.login_from < a.login_to THEN strftime({ts}, '%H:%M') >= a.login_from AND strftime({ts}, '%H:%M') < a.login_to
 ELSE strftime({ts}, '%H:%M') >= a.login_from OR strftime({ts}, '%H:%M') < a.login_to END"""


@query(
    "in_login_window",
    f"SELECT l.id, a.username, {WINDOW_SQL.format(ts='l.local_at')} AS in_window FROM (SELECT *, {LOCAL} AS local_at FROM pos_login_attempts) l JOIN pos_admins a ON a.username = l.username",
)
def in_login_window(t):
    gate = access.in_login_window(F.col("role"), F.col("login_from"), F.col("login_to"), T.local_minute(F.col("created_at")))
    return t.logins.join(t.admins.drop("id"), "username").select("id", "username", gate.alias("in_window"))


@query("window_label", "SELECT id, username, login_from || ' and ' || login_to AS label FROM pos_admins")
def window_label(t):
    return t.admins.select("id", "username", access.window_label(F.col("login_from"), F.col("login_to")).alias("label"))


@query(
    "initial_payment_state",
    "SELECT id, CASE WHEN m = 'upi' THEN 'pending' ELSE 'paid' END AS payment_status, CASE WHEN m <> 'upi' THEN created_at END AS paid_at FROM (SELECT id, created_at, lower(trim(coalesce(payment_method, 'cash'))) AS m FROM pos_bills)",
)
def initial_payment_state(t):
    from tillworks.plans.bills import opening_payment

    status, paid_at = opening_payment(clean.payment_method(F.col("payment_method")), F.col("created_at"))
    return t.bills.select("id", status.alias("payment_status"), paid_at.alias("paid_at"))


AGE = f"CAST(greatest((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) // 60000000, 0) AS BIGINT)"


@query(
    "order_age_class",
    f"""SELECT id, minutes, CASE WHEN minutes >= 25 THEN 'very-late' WHEN minutes >= 15 THEN 'late' ELSE 'on-time' END AS late,
 CASE WHEN minutes < 1 THEN 'just now' ELSE CAST(minutes AS VARCHAR) || ' min ago' END AS age FROM (SELECT id, {AGE} AS minutes FROM pos_orders)""",
)
def order_age_class(t):
    minutes = T.minutes_between(F.col("created_at"), T.instant(AS_OF))
    rows = t.orders.select("id", minutes.alias("minutes"))
    return rows.select("id", "minutes", labels.late_class(F.col("minutes")).alias("late"), labels.age_text(F.col("minutes")).alias("age"))


@query(
    "stock_badge",
    "SELECT id, CASE WHEN NOT track_stock THEN 'not tracked' WHEN stock <= 0 THEN 'out' WHEN stock <= low_stock_at THEN 'low' ELSE 'ok' END AS badge FROM pos_ingredients",
)
def stock_badge(t):
    return t.ingredients.select("id", labels.stock_badge(F.col("track_stock"), F.col("stock"), F.col("low_stock_at")).alias("badge"))


@query(
    "method_label",
    "SELECT label, count(*) AS orders FROM (SELECT CASE payment_method WHEN 'cash' THEN 'Cash' WHEN 'upi' THEN 'UPI' WHEN 'card' THEN 'Card' ELSE 'Not recorded' END AS label FROM pos_orders) GROUP BY 1",
)
def method_label(t):
    return t.orders.groupBy(labels.method_label(F.col("payment_method")).alias("label")).agg(F.count("*").alias("orders"))


HOURS_DAYS = dict(
    raw="""SELECT shop_id, i AS weekday, d AS day, json_extract(opening_hours, '$.' || d) AS e FROM pos_shop_hours,
 (VALUES (0,'mon'),(1,'tue'),(2,'wed'),(3,'thu'),(4,'fri'),(5,'sat'),(6,'sun')) w(i, d)""",
    ent="""SELECT shop_id, weekday, day, e IS NULL OR coalesce(json_extract_string(e, '$.closed') = 'true', false) AS closed, json_extract_string(e, '$.open') AS open, json_extract_string(e, '$.close') AS close FROM raw""",
    flt="""SELECT *, CASE WHEN closed THEN NULL WHEN NOT (regexp_full_match(open, '([01][0-9]|2[0-3]):[0-5][0-9]') AND regexp_full_match(close, '([01][0-9]|2[0-3]):[0-5][0-9]'))
 THEN 'Enter opening and closing times for ' || upper(day[1]) || day[2:] || ' as HH:MM, or mark it closed.' WHEN open = close THEN 'Opening and closing times for ' || upper(day[1]) || day[2:] || ' cannot be the same.' END AS fault FROM ent""",
    nrm="""SELECT shop_id, CAST(weekday AS INTEGER) AS weekday, day, closed, CASE WHEN NOT closed THEN open END AS open, CASE WHEN NOT closed THEN close END AS close,
 first_value(fault IGNORE NULLS) OVER (PARTITION BY shop_id ORDER BY weekday ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS error FROM flt""",
)


@query("hours_normalise", "SELECT * FROM nrm", **HOURS_DAYS)
def hours_normalise(t):
    return hours.normalise_hours(t.shop_hours)


@query(
    "open_state",
    """SELECT id, shop_id, is_open, CASE WHEN NOT is_open THEN CAST(wait AS INTEGER) END AS opens_in_days, CASE WHEN NOT is_open THEN CAST((SELECT o FROM wk WHERE wk.shop_id = s.shop_id AND wk.weekday = (s.weekday + wait) % 7) AS INTEGER) END AS opens_at
 FROM (SELECT m.*, (NOT y.closed AND y.c < y.o AND m.minute < y.c) OR (NOT d.closed AND m.minute >= d.o AND (d.c < d.o OR m.minute < d.c)) AS is_open,
 CASE WHEN NOT d.closed AND m.minute < d.o THEN 0 ELSE (SELECT min(i) FROM range(1, 8) r(i) JOIN wk n ON n.shop_id = m.shop_id AND n.weekday = (m.weekday + i) % 7 WHERE NOT n.closed) END AS wait
 FROM mo m JOIN wk d ON d.shop_id = m.shop_id AND d.weekday = m.weekday JOIN wk y ON y.shop_id = m.shop_id AND y.weekday = (m.weekday + 6) % 7) s""",
    **HOURS_DAYS,
    wk="""SELECT shop_id, weekday, closed, coalesce(CAST(open[1:2] AS INTEGER) * 60 + CAST(open[4:5] AS INTEGER), 0) AS o, coalesce(CAST(close[1:2] AS INTEGER) * 60 + CAST(close[4:5] AS INTEGER), 0) AS c FROM nrm WHERE error IS NULL""",
    mo=f"SELECT o_orderkey AS id, o_custkey AS shop_id, CAST(isodow({LOCAL}) AS INTEGER) - 1 AS weekday, CAST(hour({LOCAL}) * 60 + minute({LOCAL}) AS INTEGER) AS minute FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400) AS created_at FROM orders)",
)
def open_state(t):
    from tillworks.sources.adapters import order_created_at

    local = T.local_ts(order_created_at(F.col("o_orderkey"), F.col("o_orderdate")))
    moments = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("shop_id"), F.weekday(local).alias("weekday"), (F.hour(local) * 60 + F.minute(local)).alias("minute")
    )
    weeks = hours.valid_week(t.shop_hours)
    return hours.open_state(moments.join(weeks, "shop_id")).select("id", "shop_id", "is_open", "opens_in_days", "opens_at")


@query(
    "client_ip",
    """SELECT event_id AS id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.7' END AS ip FROM events""",
)
def client_ip(t):
    e = F.col("event_id")
    header = F.when(e % 7 == 0, F.lit("{}")).when(e % 5 == 0, F.lit('{"x-forwarded-for":"  , 1.2.3.4"}')).otherwise(
        F.concat(F.lit('{"host":"till","x-forwarded-for":" 10.0.'), (F.col("user_id") % 256).cast("string"), F.lit('.7 , 172.16.0.1"}'))
    )
    return t.raw("events").select(e.alias("id"), clean.client_ip(header).alias("ip"))


@query(
    "validation_rules",
    """SELECT id, concat_ws('; ', CASE WHEN phone IS NOT NULL AND NOT regexp_full_match(phone, '[0-9]{10}') THEN 'phone' END, CASE WHEN method NOT IN ('cash','upi','card') THEN 'method' END,
 CASE WHEN code <> '' AND NOT regexp_full_match(code, '[A-Z0-9_-]{3,20}') THEN 'code' END, CASE WHEN NOT regexp_full_match(username, '[a-z0-9._-]{3,32}') THEN 'username' END, CASE WHEN length(coalesce(name, '')) > 9 THEN 'name length' END) AS broken
 FROM (SELECT b.id, p.phone, lower(trim(coalesce(payment_method, 'cash'))) AS method, upper(trim(coalesce(coupon_code, ''))) AS code, lower(trim(coalesce(customer_name, ''))) AS username, nullif(trim(customer_name), '') AS name FROM pos_bills b JOIN ph p ON p.id = b.id)""",
    ph=PHONES,
)
def validation_rules(t):
    phone, method = clean.digits(F.col("phone")), clean.payment_method(F.col("payment_method"))
    code, user, name = clean.coupon_code_key(F.col("coupon_code")), clean.username_key(F.col("customer_name")), clean.blank_to_null(F.col("customer_name"))
    broken = clean.violations(
        (~clean.phone_ok(phone), "phone"),
        (~method.isin(*clean.PAYMENT_METHODS), "method"),
        ((code != "") & ~code.rlike(clean.COUPON_CODE_PATTERN), "code"),
        (~user.rlike(clean.USERNAME_PATTERN), "username"),
        (clean.longer_than(name, 9), "name length"),
    )
    return t.bills.select("id", F.array_join(broken, "; ").alias("broken"))


@query(
    "login_cursor_feed",
    f"""SELECT l.id, l.username, l.ip, l.created_at, coalesce(a.role, 'admin') AS role FROM pos_login_attempts l LEFT JOIN pos_admins a ON lower(a.username) = l.username
 WHERE l.succeeded AND l.id > 100 AND l.created_at > {EVENTS_AS_OF_SQL} - INTERVAL '1' HOUR ORDER BY l.id LIMIT 20""",
)
def login_cursor_feed(t):
    from tillworks.operators.access import logins_after

    return logins_after(t.logins, t.admins, cursor=100, as_of=EVENTS_AS_OF)


@query("login_cursor_max", "SELECT coalesce(max(id), 0) AS last_id FROM pos_login_attempts WHERE succeeded")
def login_cursor_max(t):
    from tillworks.operators.access import login_cursor

    return login_cursor(t.logins)
