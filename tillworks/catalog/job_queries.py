"""Intake, maintenance and audit jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog import coupon_queries as CQ
from tillworks.catalog.params import SHOP
from tillworks.catalog.registry import query
from tillworks.catalog.scalar_queries import RECIPE_GOOD, RECIPE_LINES, RECIPE_PAYLOADS, recipe_payloads
from tillworks.operators import diff as D
from tillworks.operators import maintain as M
from tillworks.operators import pages as P
from tillworks.plans import bills as B

A = "DECIMAL(18,2)"
BIG = 1_000_000_000


def flag(c):
    return F.lit(c).cast("boolean")


# ---- bill intake ----------------------------------------------------------

INTAKE = dict(
    cb="""SELECT x.id, x.created_at, x.created_by, x.items, nullif(regexp_replace(coalesce(x.phone, ''), '\\D', '', 'g'), '') AS phone, nullif(trim(x.customer_name), '') AS name,
 lower(trim(coalesce(x.payment_method, 'cash'))) AS method, upper(trim(coalesce(x.coupon_code, ''))) AS code FROM pos_bills x""",
    ce="""SELECT *, CASE WHEN phone IS NOT NULL AND NOT regexp_full_match(phone, '[0-9]{10}') THEN 'Enter a valid 10-digit phone number, or leave it blank.' WHEN method NOT IN ('cash', 'upi', 'card') THEN 'Choose a valid payment method.'
 WHEN items IS NULL OR json_type(items) <> 'ARRAY' OR json_array_length(items) = 0 THEN 'Add at least one item.' END AS err FROM cb""",
    b="SELECT id, phone, created_at, 'paid' AS payment_status, code FROM ce WHERE err IS NULL AND code <> ''",
    l="SELECT bill_id AS order_id, menu_item_id, qty FROM pos_bill_lines",
    pl="SELECT l.bill_id, l.line_no, l.menu_item_id, m.name AS item_name, m.price, l.qty FROM pos_bill_lines l JOIN pos_menu_items m ON m.id = l.menu_item_id AND m.is_active WHERE l.qty > 0",
    bs=f"SELECT bill_id, CAST(sum(price * qty) AS {A}) AS bill_subtotal FROM pl GROUP BY 1",
    **{k: v for k, v in CQ.SETTLE.items() if k not in ("b", "l")},
    dc="""SELECT ce.*, bs.bill_subtotal, q.coupon_id, q.discount AS coupon_discount, coalesce(ce.err, 'Coupon refused: ' || q.reason, CASE WHEN bs.bill_subtotal IS NULL THEN 'No valid items in order.' END) AS error
 FROM ce LEFT JOIN bs ON bs.bill_id = ce.id AND ce.err IS NULL LEFT JOIN q ON q.id = ce.id""",
    tk="SELECT * FROM dc WHERE error IS NULL",
    cn="""SELECT t.*, coalesce(t.name, CASE WHEN t.phone IS NOT NULL THEN coalesce(last_value(t.name IGNORE NULLS) OVER (PARTITION BY t.phone ORDER BY t.created_at, t.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c.name) END) AS customer_name
 FROM tk t LEFT JOIN pos_customers c ON c.phone = t.phone""",
)


def intake(t):
    return B.bill_intake(t.bills, t.menu, t.recipes, t.ingredients, t.coupons, t.customers)


@query(
    "bill_intake",
    f"""SELECT id, phone, customer_name, bill_subtotal AS subtotal, CAST(least(coalesce(coupon_discount, 0), bill_subtotal) AS {A}) AS discount, CAST(bill_subtotal - least(coalesce(coupon_discount, 0), bill_subtotal) AS {A}) AS total,
 coupon_id, CASE WHEN coupon_id IS NOT NULL THEN code END AS coupon_code, CASE WHEN method = 'upi' THEN 'pending' ELSE 'paid' END AS payment_status, method AS payment_method, CASE WHEN method <> 'upi' THEN created_at END AS paid_at,
 'new' AS kitchen_status, created_by, created_at FROM cn""",
    **INTAKE,
)
def bill_intake(t):
    return intake(t).orders


query("bill_intake_items", "SELECT pl.bill_id AS order_id, pl.line_no, pl.menu_item_id, pl.item_name, pl.price, pl.qty FROM pl JOIN tk ON tk.id = pl.bill_id", **INTAKE)(lambda t: intake(t).items)
query(
    "bill_intake_ingredients",
    """SELECT pl.bill_id AS order_id, pl.line_no, pl.menu_item_id, g.id AS ingredient_id, g.name AS ingredient_name, g.unit, CAST(r.qty * pl.qty AS DECIMAL(14,3)) AS qty FROM pl JOIN tk ON tk.id = pl.bill_id
 JOIN pos_menu_item_ingredients r ON r.menu_item_id = pl.menu_item_id JOIN pos_ingredients g ON g.id = r.ingredient_id""",
    **INTAKE,
)(lambda t: intake(t).ingredients)
query("bill_intake_rejects", "SELECT id, error FROM dc WHERE error IS NOT NULL", **INTAKE)(lambda t: intake(t).rejects)
query(
    "customer_upsert",
    """SELECT coalesce(c.phone, f.phone) AS phone, coalesce(f.name, c.name) AS name FROM pos_customers c FULL JOIN (SELECT phone, max_by(name, (created_at, id)) FILTER (name IS NOT NULL) AS name FROM tk WHERE phone IS NOT NULL GROUP BY 1) f ON f.phone = c.phone""",
    **INTAKE,
)(lambda t: intake(t).customers)


# ---- bill intake with stock, bill by bill -----------------------------------

def _shown(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.?0+$', '')"


def _stepwise(block: bool) -> dict[str, str]:
    """Every bill in time order with its coupon's uses and, if ``block``, what is left of every tracked ingredient."""
    short = "len(list_filter(c, lambda x: st[x.i] < x.q)) = 0" if block else "true"
    return dict(
        **{k: v for k, v in INTAKE.items() if k not in ("r1", "r2", "q", "dc", "tk", "cn")},
        cx="SELECT id, created_at + INTERVAL '1' DAY * (1 + id % 30) AS at FROM pos_orders WHERE payment_status = 'cancelled'",
        sx="SELECT o.coupon_id, o.phone, o.created_at, cx.at AS gone FROM pos_orders o LEFT JOIN cx ON cx.id = o.id WHERE o.id % 3 = 0 AND o.coupon_id IS NOT NULL",
        g="SELECT id, name, unit, stock, row_number() OVER (ORDER BY id) AS i FROM pos_ingredients WHERE track_stock",
        nd="""SELECT pl.bill_id AS order_id, g.id AS ingredient_id, g.i, CAST(sum(CAST(r.qty * pl.qty AS DECIMAL(14,3))) AS DECIMAL(24,3)) AS need FROM pl
 JOIN pos_menu_item_ingredients r ON r.menu_item_id = pl.menu_item_id JOIN g ON g.id = r.ingredient_id GROUP BY 1, 2, 3""",
        nl="SELECT order_id, list({'i': i, 'q': need} ORDER BY i) AS c FROM nd GROUP BY 1",
        su2="""SELECT e.id, count(sx.coupon_id) AS s_used, count(sx.coupon_id) FILTER (sx.phone = e.phone) AS s_mine FROM e JOIN sx ON sx.coupon_id = e.coupon_id AND sx.created_at <= e.created_at AND (sx.gone IS NULL OR sx.gone > e.created_at)
 WHERE e.early IS NULL GROUP BY 1""",
        t="""SELECT row_number() OVER (ORDER BY ce.created_at, ce.id) AS n, ce.id, ce.created_at, cx.at AS gone, e.coupon_id, ce.phone, e.early, e.usage_limit, e.per_customer_limit, e.kind, e.free_units, ce.code, bs.bill_subtotal,
 coalesce(su2.s_used, 0) AS s_used, coalesce(su2.s_mine, 0) AS s_mine, coalesce(nl.c, []) AS c FROM ce LEFT JOIN e ON e.id = ce.id LEFT JOIN su2 ON su2.id = ce.id LEFT JOIN bs ON bs.bill_id = ce.id LEFT JOIN nl ON nl.order_id = ce.id LEFT JOIN cx ON cx.id = ce.id WHERE ce.err IS NULL""",
        rc=f"""SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS STRUCT(i BIGINT, q DECIMAL(24,3), s DECIMAL(24,3))) AS lack, CAST([] AS STRUCT(c BIGINT, p VARCHAR, u TIMESTAMP)[]) AS held,
 (SELECT list(CAST(stock AS DECIMAL(24,3)) ORDER BY i) FROM g) AS st
 UNION ALL SELECT n, id, reason, lack, CASE WHEN taken AND (usage_limit IS NOT NULL OR per_customer_limit IS NOT NULL) THEN list_append(held, {{'c': CAST(coupon_id AS BIGINT), 'p': phone, 'u': gone}}) ELSE held END,
 CASE WHEN taken THEN list_transform(st, lambda s, i: s - coalesce(list_filter(c, lambda x: x.i = i)[1].q, 0)) ELSE st END FROM
 (SELECT *, reason IS NULL AND bill_subtotal IS NOT NULL AND {short} AS taken, list_transform(list_filter(c, lambda x: st[x.i] < x.q), lambda x: {{'i': x.i, 'q': x.q, 's': st[x.i]}})[1] AS lack FROM
 (SELECT *, CASE WHEN code <> '' THEN {CQ.LATE} END AS reason FROM
 (SELECT t.*, rc.held, rc.st, t.s_used + len(list_filter(rc.held, lambda h: h.c = t.coupon_id AND (h.u IS NULL OR h.u > t.created_at))) AS used,
 t.s_mine + len(list_filter(rc.held, lambda h: h.c = t.coupon_id AND h.p = t.phone AND (h.u IS NULL OR h.u > t.created_at))) AS mine FROM rc JOIN t ON t.n = rc.n + 1)))""",
        dc=f"""SELECT ce.id, ce.created_at, bs.bill_subtotal, pr.discount AS coupon_discount, coalesce(ce.err, 'Coupon refused: ' || rc.reason, CASE WHEN bs.bill_subtotal IS NULL THEN 'No valid items in order.' END,
 {"CASE WHEN rc.lack IS NOT NULL THEN 'Not enough ' || g.name || ': ' || " + _shown("rc.lack.s") + " || ' ' || g.unit || ' left, this bill needs ' || " + _shown("rc.lack.q") + " || ' ' || g.unit || '.' END" if block else "NULL"}) AS error
 FROM ce LEFT JOIN bs ON bs.bill_id = ce.id AND ce.err IS NULL LEFT JOIN rc ON rc.id = ce.id LEFT JOIN pr ON pr.id = ce.id LEFT JOIN g ON g.i = rc.lack.i""",
        mv="""SELECT nd.order_id, nd.ingredient_id, CAST(-nd.need AS DECIMAL(14,3)) AS qty, CAST(g.stock - sum(nd.need) OVER (PARTITION BY nd.ingredient_id ORDER BY dc.created_at, dc.id ROWS UNBOUNDED PRECEDING) AS DECIMAL(24,3)) AS balance_after
 FROM nd JOIN dc ON dc.id = nd.order_id AND dc.error IS NULL JOIN g ON g.id = nd.ingredient_id""",
    )


def stocked(t, block: bool = SHOP.hide_out_of_stock):
    """The raw bills against the coupon uses of a third of the orders, stored under numbers of their own."""
    stored = t.orders.filter("id % 3 = 0").withColumn("id", -F.col("id"))
    cancels = CQ.cancellations(t).unionByName(CQ.cancellations(t, -1))
    return B.bill_intake_with_stock(t.bills, t.menu, t.recipes, t.ingredients, t.coupons, t.customers, stored, cancels, block)


@query(
    "bill_intake_stock",
    f"""SELECT id, error, CASE WHEN error IS NULL THEN CAST(bill_subtotal AS {A}) END AS subtotal, CASE WHEN error IS NULL THEN CAST(least(coalesce(coupon_discount, 0), bill_subtotal) AS {A}) END AS discount FROM dc""",
    **_stepwise(True),
)
def bill_intake_stock(t):
    """Every raw bill: taken, with its sums, or refused, with the first failing rule."""
    found = stocked(t)[0]
    taken = found.orders.select("id", F.lit(None).cast("string").alias("error"), "subtotal", "discount")
    return taken.unionByName(found.rejects.select("id", "error", F.lit(None).cast("decimal(18,2)").alias("subtotal"), F.lit(None).cast("decimal(18,2)").alias("discount")))


@query("bill_intake_stock_moves", "SELECT * FROM mv", **_stepwise(True))
def bill_intake_stock_moves(t):
    return stocked(t)[1].select("order_id", "ingredient_id", "qty", "balance_after")


@query("bill_intake_stock_warnings", "SELECT m.order_id, g.name, g.unit, m.balance_after AS stock FROM mv m JOIN g ON g.id = m.ingredient_id WHERE m.balance_after < 0", **_stepwise(False))
def bill_intake_stock_warnings(t):
    """Without blocking: what each taken bill leaves below zero."""
    names = t.ingredients.select(F.col("id").alias("ingredient_id"), "name", "unit")
    return stocked(t, block=False)[1].filter("warn").join(names, "ingredient_id").select("order_id", "name", "unit", F.col("balance_after").alias("stock"))


# ---- staged edits ---------------------------------------------------------


def menu_stage(t):
    k = F.col("p_partkey")
    part = t.raw("part")
    row = lambda df, id_, new: df.select(
        (id_ + 0).alias("seq"),
        id_.alias("id"),
        F.lit(new).alias("is_new"),
        F.when(k % 77 == 0, F.lit("  ")).when(F.lit(new), F.concat(F.lit("Special "), k.cast("string"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("name"),
        F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("category"),
        (F.col("p_retailprice").cast("decimal(10,2)") + k % 2).cast("decimal(10,2)").alias("price"),
        F.when(k % 5 != 0, k % 11 != 0).alias("is_active"),
        F.when(k % 21 == 0, F.lit("ftp://img")).when(k % 14 == 0, F.concat(F.lit("https://img/"), k.cast("string"))).alias("image_url"),
    )
    return row(part.filter(k % 7 == 0), k, False).unionByName(row(part.filter(k % 50 == 0), k + BIG, True)).unionByName(row(part.filter(k % 90 == 1), k + 2 * BIG, False))


_MENU_ROW = """SELECT {id} AS seq, {id} AS id, {new} AS is_new, CASE WHEN k % 77 = 0 THEN '  ' WHEN {new} THEN 'Special ' || CAST(k AS VARCHAR) ELSE ' ' || p_name || ' ' END AS name, CASE WHEN k % 3 = 0 THEN ' ' ELSE p_type END AS category,
 CAST(CAST(p_retailprice AS DECIMAL(10,2)) + k % 2 AS DECIMAL(10,2)) AS price, CASE WHEN k % 5 <> 0 THEN k % 11 <> 0 END AS is_active, CASE WHEN k % 21 = 0 THEN 'ftp://img' WHEN k % 14 = 0 THEN 'https://img/' || CAST(k AS VARCHAR) END AS image_url
 FROM (SELECT *, p_partkey AS k FROM part) WHERE {cond}"""
MENU_STAGE = dict(
    sm=" UNION ALL ".join(_MENU_ROW.format(id=i, new=n, cond=c) for i, n, c in (("k", "false", "k % 7 = 0"), (f"k + {BIG}", "true", "k % 50 = 0"), (f"k + {2 * BIG}", "false", "k % 90 = 1"))),
    ed="""SELECT s.id, s.is_new, nullif(trim(s.name), '') AS name, coalesce(nullif(trim(s.category), ''), 'General') AS category, s.price, coalesce(s.is_active, true) AS is_active, nullif(trim(s.image_url), '') AS image_url,
 CASE WHEN nullif(trim(s.name), '') IS NULL THEN 'Name is required.' WHEN s.image_url IS NOT NULL AND NOT regexp_matches(s.image_url, '^https?://') THEN 'Image URL must start with http:// or https://' WHEN NOT s.is_new AND m.id IS NULL THEN 'Menu item not found.' END AS error
 FROM sm s LEFT JOIN pos_menu_items m ON m.id = s.id""",
    mg="""SELECT coalesce(o.id, n.id) AS id, o.id IS NOT NULL AS was, n.id IS NOT NULL AS edited, o.name AS oname, o.category AS ocategory, o.price AS oprice, o.is_active AS oactive, NULL AS oimage, n.name, n.category, n.price, n.is_active, n.image_url
 FROM pos_menu_items o FULL JOIN (SELECT * FROM ed WHERE error IS NULL) n ON n.id = o.id""",
    ch="""SELECT *, '{' || concat_ws(',', CASE WHEN category <> ocategory THEN '"category":["' || ocategory || '","' || category || '"]' END, CASE WHEN image_url IS NOT NULL THEN '"image_url":[null,"' || image_url || '"]' END,
 CASE WHEN is_active <> oactive THEN '"is_active":[' || CAST(oactive AS VARCHAR) || ',' || CAST(is_active AS VARCHAR) || ']' END, CASE WHEN name <> oname THEN '"name":["' || oname || '","' || name || '"]' END,
 CASE WHEN price <> oprice THEN '"price":[' || rtrim(rtrim(CAST(oprice AS VARCHAR), '0'), '.') || ',' || rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.') || ']' END) || '}' AS diff FROM mg""",
    mt="""SELECT id, CASE WHEN edited THEN name ELSE oname END AS name, CASE WHEN edited THEN category ELSE ocategory END AS category, CASE WHEN edited THEN price ELSE oprice END AS price, CASE WHEN edited THEN is_active ELSE oactive END AS is_active,
 CASE WHEN edited THEN image_url END AS image_url, CASE WHEN NOT edited THEN 'kept' WHEN NOT was THEN 'created' WHEN diff = '{}' THEN 'unchanged' ELSE 'updated' END AS outcome, CASE WHEN was AND edited AND diff <> '{}' THEN diff END AS changes FROM ch""",
)


def menu_now(t):
    return t.menu.withColumn("image_url", F.lit(None).cast("string"))


@query("menu_upsert", "SELECT * FROM mt UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, error, NULL FROM ed WHERE error IS NOT NULL", **MENU_STAGE)
def menu_upsert(t):
    current = menu_now(t)
    return M.apply_edits(current, M.menu_edits(menu_stage(t), current), M.MENU_COLUMNS)


def menu_after(t):
    current = menu_now(t)
    after = M.apply_edits(current, M.menu_edits(menu_stage(t), current), M.MENU_COLUMNS)
    return after.filter("outcome in ('kept', 'created', 'updated', 'unchanged') and id % 13 <> 0").select("id", *M.MENU_COLUMNS)


@query(
    "snapshot_diff",
    """SELECT CAST(id AS VARCHAR) AS entity_id, CASE WHEN NOT was THEN 'menu.create' WHEN id % 13 = 0 THEN 'menu.delete' ELSE 'menu.update' END AS action,
 CASE WHEN was AND id % 13 <> 0 THEN '{"name":"' || name || '","changes":' || diff || '}'
 WHEN was THEN '{"name":"' || oname || '","category":"' || ocategory || '","price":' || CAST(oprice AS VARCHAR) || ',"is_active":' || CAST(oactive AS VARCHAR) || ',"image_url":null}'
 ELSE '{"name":"' || name || '","category":"' || category || '","price":' || CAST(price AS VARCHAR) || ',"is_active":' || CAST(is_active AS VARCHAR) || ',"image_url":' || coalesce('"' || image_url || '"', 'null') || '}' END AS details
 FROM ch WHERE (NOT was AND id % 13 <> 0) OR (was AND id % 13 = 0) OR (was AND edited AND diff <> '{}' AND id % 13 <> 0)""",
    **MENU_STAGE,
)
def snapshot_diff(t):
    return D.snapshot_diff(menu_now(t), menu_after(t), "id", M.MENU_COLUMNS, "menu", "name")


@query(
    "field_changes",
    """SELECT id, 'category' AS field, '"' || ocategory || '"' AS old, '"' || category || '"' AS new FROM x WHERE category <> ocategory UNION ALL SELECT id, 'image_url', 'null', '"' || image_url || '"' FROM x WHERE image_url IS NOT NULL
 UNION ALL SELECT id, 'is_active', CAST(oactive AS VARCHAR), CAST(is_active AS VARCHAR) FROM x WHERE is_active <> oactive UNION ALL SELECT id, 'name', '"' || oname || '"', '"' || name || '"' FROM x WHERE name <> oname
 UNION ALL SELECT id, 'price', rtrim(rtrim(CAST(oprice AS VARCHAR), '0'), '.'), rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.') FROM x WHERE price <> oprice""",
    **MENU_STAGE,
    x="SELECT * FROM ch WHERE was AND edited AND id % 13 <> 0",
)
def field_changes(t):
    return D.field_changes(menu_now(t), menu_after(t), "id", M.MENU_COLUMNS)


@query(
    "key_union",
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'a,b,' || k3 WHEN id % 3 = 1 THEN 'a,' || k3 ELSE 'a' END AS keys FROM (SELECT p_partkey AS id, 'k' || CAST(p_size AS VARCHAR) AS k3 FROM part)",
)
def key_union(t):
    k = F.col("p_partkey")
    dyn = F.concat(F.lit('"k'), F.col("p_size").cast("string"), F.lit('":1'))
    old = F.when(k % 3 == 0, F.lit('{"b":null,"a":1}')).otherwise(F.lit('{"a":2}'))
    new = F.when(k % 3 == 2, F.lit(None)).otherwise(F.concat(F.lit('{"a":1,'), dyn, F.lit("}")))
    return t.raw("part").select(k.alias("id"), F.array_join(D.key_union(old, new), ",").alias("keys"))


def ingredient_stage(t):
    k = F.col("s_suppkey")
    neighbour = F.concat(F.lit("supplier#"), F.lpad((k + 1).cast("string"), 9, "0"))
    edits = t.raw("supplier").filter(k % 3 == 0).select(
        k.alias("seq"), k.alias("id"), F.lit(False).alias("is_new"),
        F.when(k % 15 == 0, neighbour).when(k % 9 == 0, F.concat(F.lit("Fresh "), k.cast("string"))).otherwise(F.concat(F.lit(" "), F.col("s_name"), F.lit(" "))).alias("name"),
        F.when(k % 12 == 0, "cup").otherwise("kg").alias("unit"),
    )
    new = t.raw("supplier").filter(k % 10 == 1).select(
        (k + BIG).alias("seq"), (k + BIG).alias("id"), F.lit(True).alias("is_new"), F.concat(F.lit("Extra "), F.floor(k / 20).cast("string")).alias("name"), F.lit("g").alias("unit")
    )
    return edits.unionByName(new)


INGREDIENT_STAGE = dict(
    si=f"""SELECT k AS seq, k AS id, false AS is_new, CASE WHEN k % 15 = 0 THEN 'supplier#' || lpad(CAST(k + 1 AS VARCHAR), 9, '0') WHEN k % 9 = 0 THEN 'Fresh ' || CAST(k AS VARCHAR) ELSE ' ' || s_name || ' ' END AS name, CASE WHEN k % 12 = 0 THEN 'cup' ELSE 'kg' END AS unit
 FROM (SELECT *, s_suppkey AS k FROM supplier) WHERE k % 3 = 0 UNION ALL SELECT k + {BIG}, k + {BIG}, true, 'Extra ' || CAST(k // 20 AS VARCHAR), 'g' FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 10 = 1""",
    e1="SELECT seq, id, is_new, nullif(trim(name), '') AS name, unit, CASE WHEN unit NOT IN ('g', 'kg', 'ml', 'l', 'pcs') THEN 'Choose a valid unit.' END AS e FROM si",
    hd="SELECT lower(name) AS k, id, -1 AS seq FROM pos_ingredients WHERE id NOT IN (SELECT id FROM e1 WHERE e IS NULL) UNION ALL SELECT lower(name), id, seq FROM e1 WHERE e IS NULL",
    ed="""SELECT e1.*, CASE WHEN e IS NOT NULL THEN e WHEN e1.id <> (SELECT min_by(h.id, (h.seq, h.id)) FROM hd h WHERE h.k = lower(e1.name)) THEN 'An ingredient named "' || e1.name || '" already exists.' END AS error FROM e1""",
)


@query(
    "ingredient_upsert",
    """SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.unit, o.unit) AS unit, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'created' WHEN n.name = o.name AND n.unit = o.unit THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM pos_ingredients o FULL JOIN (SELECT * FROM ed WHERE error IS NULL) n ON n.id = o.id UNION ALL SELECT id, NULL, NULL, error FROM ed WHERE error IS NOT NULL""",
    **INGREDIENT_STAGE,
)
def ingredient_upsert(t):
    edits = M.ingredient_edits(ingredient_stage(t), t.ingredients)
    return M.apply_edits(t.ingredients, edits, M.INGREDIENT_COLUMNS).drop("changes")


@query("duplicate_key_probe", "SELECT id FROM ed WHERE error LIKE 'An ingredient named % already exists.'", **INGREDIENT_STAGE)
def duplicate_key_probe(t):
    checked = M.ingredient_edits(ingredient_stage(t), t.ingredients)
    return checked.filter("error like 'An ingredient named % already exists.'").select("id")


@query(
    "stock_settings_upsert",
    """SELECT i.id, coalesce(n.tr, i.track_stock) AS track_stock, CASE WHEN n.id IS NULL THEN i.low_stock_at ELSE n.lv END AS low_stock_at, CASE WHEN n.id IS NULL THEN 'kept' WHEN n.tr = i.track_stock AND n.lv IS NOT DISTINCT FROM i.low_stock_at THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM pos_ingredients i LEFT JOIN s n ON n.id = i.id AND n.lv IS DISTINCT FROM -5 UNION ALL SELECT id, NULL, NULL, CASE WHEN lv < 0 THEN 'Low stock alert must be 0 or more.' ELSE 'Ingredient not found.' END FROM s WHERE lv < 0 OR id >= 1000000000""",
    s=f"""SELECT k AS id, CASE k % 3 WHEN 0 THEN true ELSE false END AS tr, CAST(CASE WHEN k % 8 = 1 THEN -5 WHEN k % 8 = 5 THEN k * 10 END AS DECIMAL(14,3)) AS lv FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 4 = 1
 UNION ALL SELECT k + {BIG}, true, NULL FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 40 = 0""",
)
def stock_settings_upsert(t):
    k = F.col("s_suppkey")
    level = F.when(k % 8 == 1, F.lit(-5)).when(k % 8 == 5, k * 10).cast("decimal(14,3)")
    edits = t.raw("supplier").filter(k % 4 == 1).select(k.alias("seq"), k.alias("id"), F.lit(False).alias("is_new"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("track_stock"), level.alias("low_stock_at"))
    lost = t.raw("supplier").filter(k % 40 == 0).select((k + BIG).alias("seq"), (k + BIG).alias("id"), F.lit(False).alias("is_new"), F.lit(True).alias("track_stock"), F.lit(None).cast("decimal(14,3)").alias("low_stock_at"))
    return M.apply_edits(t.ingredients, M.stock_setting_edits(edits.unionByName(lost), t.ingredients), M.STOCK_SETTING_COLUMNS).drop("changes")


def staff_stage(t):
    k = F.col("c_custkey")
    fresh = t.raw("customer").filter(k % 10 == 5).select(
        (k + BIG).alias("seq"), (k + BIG).alias("id"), F.lit(True).alias("is_new"),
        F.when(k % 4 == 1, F.lit(" STAFF7 ")).when(k % 15 == 0, F.lit("x y")).otherwise(F.concat(F.lit(" User."), k.cast("string"), F.lit(" "))).alias("username"),
        F.when(k % 3 == 0, "super").when(k % 3 == 1, "boss").alias("role"), F.lit(None).cast("boolean").alias("is_active"),
        F.when(k % 20 == 15, F.lit(" ")).otherwise("08:00").alias("login_from"), F.lit("18:00").alias("login_to"), flag(False).alias("auto_approve"),
    )
    a = F.col("id")
    edits = t.admins.filter(a % 4 == 1).select(
        a.alias("seq"), "id", F.lit(False).alias("is_new"), F.concat(F.col("username"), F.when(a % 8 == 1, F.lit("x")).otherwise("")).alias("username"),
        F.when(a % 8 == 5, "super").otherwise("admin").alias("role"), (a != 13).alias("is_active"), F.lit("").alias("login_from"), F.lit("").alias("login_to"), flag(True).alias("auto_approve"),
    )
    return fresh.unionByName(edits)


STAFF_STAGE = dict(
    ss=f"""SELECT k + {BIG} AS id, true AS is_new, CASE WHEN k % 4 = 1 THEN ' STAFF7 ' WHEN k % 15 = 0 THEN 'x y' ELSE ' User.' || CAST(k AS VARCHAR) || ' ' END AS username, CASE k % 3 WHEN 0 THEN 'super' WHEN 1 THEN 'boss' END AS role, CAST(NULL AS BOOLEAN) AS is_active,
 CASE WHEN k % 20 = 15 THEN ' ' ELSE '08:00' END AS login_from, '18:00' AS login_to, false AS auto_approve FROM (SELECT c_custkey AS k FROM customer) WHERE k % 10 = 5
 UNION ALL SELECT id, false, username || CASE WHEN id % 8 = 1 THEN 'x' ELSE '' END, CASE WHEN id % 8 = 5 THEN 'super' ELSE 'admin' END, id <> 13, '', '', true FROM pos_admins WHERE id % 4 = 1""",
    sn="""SELECT id, is_new, lower(trim(username)) AS username, coalesce(role, 'admin') AS role, coalesce(is_active, true) AS is_active, nullif(trim(login_from), '') AS login_from, nullif(trim(login_to), '') AS login_to, auto_approve FROM ss""",
    e1="""SELECT *, CASE WHEN NOT regexp_full_match(username, '[a-z0-9._-]{3,32}') THEN 'Username must be 3-32 characters: letters, numbers, dot, dash or underscore.' WHEN role NOT IN ('super', 'admin') THEN 'Choose a valid role.'
 WHEN (login_from IS NULL) <> (login_to IS NULL) THEN 'Set both a start and an end time for the login hours, or leave both blank.' END AS e FROM sn""",
    ed="""SELECT id, is_new, username, role, is_active, CASE WHEN role <> 'super' THEN login_from END AS login_from, CASE WHEN role <> 'super' THEN login_to END AS login_to, role = 'super' OR auto_approve AS auto_approve,
 CASE WHEN e IS NOT NULL THEN e WHEN e1.username = 'staff7' AND e1.id <> 7 THEN 'Username "staff7" is already taken.' END AS error FROM e1""",
)


@query(
    "staff_upsert",
    """SELECT coalesce(o.id, n.id) AS id, coalesce(n.username, o.username) AS username, coalesce(n.role, o.role) AS role, coalesce(n.is_active, o.is_active) AS is_active, CASE WHEN n.id IS NULL THEN o.login_from ELSE n.login_from END AS login_from,
 CASE WHEN n.id IS NULL THEN o.login_to ELSE n.login_to END AS login_to, coalesce(n.auto_approve, o.auto_approve) AS auto_approve, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'created'
 WHEN (n.username, n.role, n.is_active, n.auto_approve) = (o.username, o.role, o.is_active, o.auto_approve) AND n.login_from IS NOT DISTINCT FROM o.login_from AND n.login_to IS NOT DISTINCT FROM o.login_to THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM pos_admins o FULL JOIN (SELECT * FROM ed WHERE error IS NULL) n ON n.id = o.id UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, error FROM ed WHERE error IS NOT NULL""",
    **STAFF_STAGE,
)
def staff_upsert(t):
    return M.apply_edits(t.admins, M.staff_edits(staff_stage(t), t.admins), M.STAFF_COLUMNS).drop("changes")


@query(
    "staff_sessions_revoked",
    "SELECT s.id, s.admin_id FROM pos_sessions s WHERE s.admin_id NOT IN (SELECT a.id FROM pos_admins a JOIN ed ON ed.id = a.id AND ed.error IS NULL WHERE a.role <> ed.role OR (a.is_active AND NOT ed.is_active))",
    **STAFF_STAGE,
)
def staff_sessions_revoked(t):
    return M.sessions_after_staff_edits(t.sessions, t.admins, M.staff_edits(staff_stage(t), t.admins)).select("id", "admin_id")


def coupon_stage(t):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    n = k % 10
    kind = F.when(n < 4, "Percent ").when(n < 7, "flat").when(n < 9, "bogo").otherwise("free")
    fields = F.concat_ws(
        ",",
        F.concat(F.lit('"code":" sale'), s(F.floor(k / 10)), F.lit('-'), s(n), F.lit(' "')),
        F.concat(F.lit('"kind":"'), kind, F.lit('"')),
        F.concat(F.lit('"value":"'), s(k % 120), F.lit('"')),
        F.when(k % 4 == 0, F.lit('"max_discount":"250"')),
        F.when(k % 9 == 1, F.lit('"min_bill":"-1"')),
        F.when(n >= 7, F.concat(F.lit('"buy_qty":2,"get_qty":'), s(k % 3))),
        F.when(k % 3 == 0, F.concat(F.lit('"applies_to":" ITEMS","item_ids":["7","3",7],"categories":[" A ",""]'))),
        F.when(k % 31 == 0, F.lit('"applies_to":"items"')),
        F.when(k % 6 == 1, F.lit('"valid_from":"2000-01-01","valid_to":"1999-01-01"')),
        F.when(k % 8 == 3, F.lit('"usage_limit":"0"')),
    )
    return t.raw("part").filter(k % 31 != 0).select((k + 1000).alias("seq"), (k + 1000).alias("id"), F.lit(True).alias("is_new"), F.concat(F.lit("{"), fields, F.lit("}")).alias("payload"))


COUPON_STAGE = dict(
    sc="""SELECT k + 1000 AS id, 'SALE' || CAST(k // 10 AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR) AS code, CASE WHEN k % 10 < 4 THEN 'percent' WHEN k % 10 < 7 THEN 'flat' WHEN k % 10 < 9 THEN 'bogo' ELSE 'free' END AS kind, CAST(k % 120 AS DECIMAL(10,2)) AS value,
 CASE WHEN k % 4 = 0 THEN CAST(250 AS DECIMAL(10,2)) END AS max_discount, CAST(CASE WHEN k % 9 = 1 THEN -1 ELSE 0 END AS DECIMAL(10,2)) AS min_bill, CASE WHEN k % 3 = 0 THEN 'items' ELSE 'all' END AS applies_to, k FROM (SELECT p_partkey AS k FROM part) WHERE k % 31 <> 0""",
    ed="""SELECT id, code, kind, CASE WHEN kind = 'bogo' THEN 0 ELSE value END AS value, CASE WHEN kind <> 'flat' THEN max_discount END AS max_discount, applies_to, CASE WHEN applies_to = 'items' THEN '3,7' ELSE '' END AS item_ids, CASE WHEN applies_to = 'items' THEN 'A' ELSE '' END AS categories,
 CASE WHEN kind = 'free' THEN 'Choose a coupon type.' WHEN kind = 'percent' AND (value <= 0 OR value > 100) THEN 'Percentage must be more than 0 and at most 100.' WHEN kind = 'flat' AND value <= 0 THEN 'Discount amount must be more than 0.'
 WHEN kind = 'bogo' AND k % 3 < 1 THEN 'Buy and free quantities must both be at least 1.' WHEN min_bill < 0 THEN 'Minimum bill cannot be negative.' WHEN k % 6 = 1 THEN 'Valid until must be on or after valid from.' WHEN k % 8 = 3 THEN 'Total uses must be at least 1, or blank.' END AS error FROM sc""",
)


@query("coupon_upsert", "SELECT id, code, kind, CAST(value AS DECIMAL(10,2)) AS value, max_discount, applies_to, item_ids, categories, coalesce(error, 'ok') AS outcome FROM ed", **COUPON_STAGE)
def coupon_upsert(t):
    edits = M.coupon_edits(coupon_stage(t), t.coupons)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return edits.select("id", "code", "kind", "value", "max_discount", "applies_to", join("item_ids"), join("categories"), F.coalesce("error", F.lit("ok")).alias("outcome"))


@query(
    "recipe_replace",
    """SELECT menu_item_id, ingredient_id, CAST(qty AS DECIMAL(12,3)) AS qty FROM (SELECT * FROM pos_menu_item_ingredients WHERE menu_item_id NOT IN (SELECT menu_item_id FROM gi)
 UNION ALL SELECT rg.menu_item_id, rg.ingredient_id, sum(rg.qty) FROM rg JOIN pos_ingredients i ON i.id = rg.ingredient_id GROUP BY 1, 2)""",
    rp=RECIPE_PAYLOADS,
    rl=RECIPE_LINES,
    rg=RECIPE_GOOD,
    gi="SELECT DISTINCT menu_item_id FROM rg",
)
def recipe_replace(t):
    return M.replace_recipes(t.recipes, recipe_payloads(t), t.menu, t.ingredients)[0]


def settings_patches(t):
    k = F.col("c_custkey")
    parts = F.concat_ws(
        ",",
        F.when(k % 13 != 0, F.concat(F.lit('"shop_name":" Shop '), k.cast("string"), F.lit(' "'))),
        F.when(k % 5 == 0, F.lit('"currency":"Rupees"')).otherwise(F.lit('"currency":"₹"')),
        F.lit('"shop_phone":"080-1"'),
        F.when(k % 4 == 1, F.lit('"tagline":"  "')),
        F.when(k % 3 == 1, F.lit('"whatsapp":"+91 98765-43210"')),
        F.when(k % 7 == 2, F.lit('"maps_url":"maps/2"')),
        F.when(k % 6 == 0, F.lit('"hide_out_of_stock":false')),
        F.when(k % 11 == 3, F.lit('"upi_id":"no at"')),
        F.when(k % 8 == 1, F.lit('"country_code":"+1"')),
    )
    return t.raw("customer").filter(k % 2 == 1).select(k.alias("id"), F.concat(F.lit("{"), parts, F.lit("}")).alias("patch"))


@query(
    "settings_patch",
    """SELECT id, CASE WHEN e IS NOT NULL OR k % 8 <> 1 THEN '91' ELSE '1' END AS country_code, CASE WHEN e IS NULL AND k % 4 = 1 THEN NULL ELSE 'Fresh' END AS tagline, CASE WHEN e IS NULL AND k % 3 = 1 THEN '919876543210' END AS whatsapp,
 CASE WHEN e IS NOT NULL OR k % 6 <> 0 THEN true ELSE false END AS hide_out_of_stock, e AS error,
 CASE WHEN e IS NULL AND (k % 8 = 1 OR k % 4 = 1 OR k % 3 = 1) THEN '{' || concat_ws(',', CASE WHEN k % 8 = 1 THEN '"country_code":["91","1"]' END, CASE WHEN k % 4 = 1 THEN '"tagline":["Fresh",null]' END, CASE WHEN k % 3 = 1 THEN '"whatsapp":[null,"919876543210"]' END) || '}' END AS changes
 FROM (SELECT c_custkey AS id, c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'Shop name is required.' WHEN c_custkey % 5 = 0 THEN 'Currency symbol must be 1-5 characters.' WHEN c_custkey % 11 = 3 THEN 'Enter a valid UPI ID, e.g. myshop@okaxis.'
 WHEN c_custkey % 7 = 2 THEN 'Google Maps link must start with https://' END AS e FROM customer WHERE c_custkey % 2 = 1)""",
)
def settings_patch(t):
    return M.patch_settings(t.settings, settings_patches(t)).select("id", "country_code", "tagline", "whatsapp", "hide_out_of_stock", "error", "changes")


# ---- deletes, backfills, constraints --------------------------------------


@query(
    "cascade_delete",
    """SELECT 'recipe' AS child, menu_item_id AS key, count(*) AS rows FROM pos_menu_item_ingredients WHERE menu_item_id % 10 <> 3 GROUP BY 2
 UNION ALL SELECT 'order_item', CASE WHEN menu_item_id % 10 <> 3 THEN menu_item_id END, count(*) FROM pos_order_items GROUP BY 2
 UNION ALL SELECT 'order', CASE WHEN created_by NOT IN (SELECT id FROM pos_admins WHERE id % 6 = 5) THEN created_by END, count(*) FROM pos_orders GROUP BY 2
 UNION ALL SELECT 'session', admin_id, count(*) FROM pos_sessions WHERE admin_id NOT IN (SELECT id FROM pos_admins WHERE id % 6 = 5) GROUP BY 2
 UNION ALL SELECT 'audit:' || action, CAST(entity_id AS BIGINT), 1 FROM (SELECT 'menu.delete' AS action, CAST(id AS VARCHAR) AS entity_id FROM pos_menu_items WHERE id % 10 = 3)""",
)
def cascade_delete(t):
    """Menu items and accounts removed: recipes and sessions go, order lines and bills lose the reference, snapshots stay."""
    items = t.menu.filter("id % 10 = 3").select("id")
    people = t.admins.filter("id % 6 = 5").select("id")
    count = lambda df, name, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("child"), "key", "rows")
    frames = [
        count(M.without(t.recipes, items, "menu_item_id"), "recipe", "menu_item_id"),
        count(M.orphaned(t.order_lines, items, "menu_item_id"), "order_item", "menu_item_id"),
        count(M.orphaned(t.orders.select("id", "created_by"), people, "created_by"), "order", "created_by"),
        count(M.without(t.sessions, people, "admin_id"), "session", "admin_id"),
        M.delete_snapshots(t.menu, items, ["name", "category", "price", "is_active"], "menu").select(
            F.concat(F.lit("audit:"), F.col("action")).alias("child"), F.col("entity_id").cast("bigint").alias("key"), F.lit(1).cast("bigint").alias("rows")
        ),
    ]
    return M.union_all(frames)


@query(
    "backfills",
    """SELECT id, CASE WHEN payment_status = 'paid' AND id % 3 = 0 THEN kitchen_updated_at END AS raw_paid_at, CASE WHEN payment_status = 'paid' THEN coalesce(CASE WHEN id % 3 = 0 THEN kitchen_updated_at END, created_at) END AS paid_at,
 CAST(coalesce(CASE WHEN id % 2 = 0 THEN total + discount END, total) AS DECIMAL(12,2)) AS subtotal, CASE WHEN created_at < TIMESTAMP '1997-01-01' THEN 'served' ELSE kitchen_status END AS kitchen_status FROM pos_orders""",
)
def backfills(t):
    paid = F.when((F.col("payment_status") == "paid") & (F.col("id") % 3 == 0), F.col("kitchen_updated_at"))
    rows = t.orders.withColumn("paid_at", paid).withColumn("raw_paid_at", paid).withColumn("subtotal", F.when(F.col("id") % 2 == 0, F.col("total") + F.col("discount")).cast("decimal(12,2)"))
    return M.backfill_orders(rows, "1997-01-01").select("id", "raw_paid_at", "paid_at", F.col("subtotal").cast("decimal(12,2)").alias("subtotal"), "kitchen_status")


@query(
    "constraint_audit",
    """SELECT 'orders.total >= 0' AS rule, count(*) FILTER (total < 0) AS violations FROM pos_orders UNION ALL SELECT 'orders.payment_method known', count(*) FILTER (payment_method NOT IN ('cash', 'upi', 'card')) FROM pos_orders
 UNION ALL SELECT 'orders.payment_method present', count(*) FILTER (payment_method IS NULL) FROM pos_orders UNION ALL SELECT 'orders.discount <= total', count(*) FILTER (discount > total) FROM pos_orders
 UNION ALL SELECT 'order_items.qty > 0', count(*) FILTER (qty <= 0) FROM pos_order_items UNION ALL SELECT 'stock.qty > 0', count(*) FILTER (kind <> 'count' AND qty <= 0) FROM pos_stock_events
 UNION ALL SELECT 'ingredients.stock >= 0', count(*) FILTER (stock < 0) FROM pos_ingredients
 UNION ALL SELECT 'orders.created_by exists', count(*) FROM pos_orders WHERE created_by IS NOT NULL AND created_by NOT IN (SELECT id FROM pos_admins)
 UNION ALL SELECT 'orders.coupon_id exists', count(*) FROM pos_orders WHERE coupon_id IS NOT NULL AND coupon_id NOT IN (SELECT id FROM pos_coupons)
 UNION ALL SELECT 'stock.ingredient_id exists', count(*) FROM pos_stock_events WHERE ingredient_id NOT IN (SELECT id FROM pos_ingredients)
 UNION ALL SELECT 'customers.phone unique', count(*) - count(DISTINCT phone) FROM pos_customers UNION ALL SELECT 'menu.name unique', count(*) - count(DISTINCT lower(name)) FROM pos_menu_items
 UNION ALL SELECT 'one open shift', count(*) - count(DISTINCT admin_id) FROM pos_shifts WHERE closed_at IS NULL""",
)
def constraint_audit(t):
    c = F.col
    return M.union_all(
        [
            M.rule_counts(
                t.orders,
                {
                    "orders.total >= 0": c("total") >= 0,
                    "orders.payment_method known": c("payment_method").isin("cash", "upi", "card"),
                    "orders.payment_method present": c("payment_method").isNotNull(),
                    "orders.discount <= total": c("discount") <= c("total"),
                },
            ),
            M.rule_counts(t.order_lines, {"order_items.qty > 0": c("qty") > 0}),
            M.rule_counts(t.stock_events, {"stock.qty > 0": (c("kind") == "count") | (c("qty") > 0)}),
            M.rule_counts(t.ingredients, {"ingredients.stock >= 0": c("stock") >= 0}),
            M.missing_parents(t.orders, "created_by", t.admins, "orders.created_by exists"),
            M.missing_parents(t.orders, "coupon_id", t.coupons, "orders.coupon_id exists"),
            M.missing_parents(t.stock_events, "ingredient_id", t.ingredients, "stock.ingredient_id exists"),
            M.repeated_keys(t.customers, c("phone"), "customers.phone unique"),
            M.repeated_keys(t.menu, F.lower("name"), "menu.name unique"),
            M.repeated_keys(t.shifts.filter("closed_at is null"), c("admin_id"), "one open shift"),
        ]
    )


# ---- audit feed -----------------------------------------------------------

AUDIT_DOCS = dict(
    ad="""SELECT *, id % 100 AS k FROM pos_audit_log""",
    rd="""SELECT id, action, entity_id, created_at, CASE action WHEN 'order.status' THEN 'Bill status changed' WHEN 'kitchen.status' THEN 'Kitchen status changed' WHEN 'stock.purchase' THEN 'Stock purchased' WHEN 'staff.create' THEN 'User added' ELSE 'Menu item edited' END AS label,
 CASE WHEN action IN ('order.status', 'kitchen.status') THEN 'Order #' || entity_id WHEN action = 'stock.purchase' THEN 'Item ' || CAST(k AS VARCHAR) WHEN action = 'staff.create' THEN 'user' || CAST(k AS VARCHAR) ELSE 'Dish ' || CAST(k AS VARCHAR) END AS target,
 CASE action WHEN 'order.status' THEN 'pending → ' || CASE WHEN id % 2 = 0 THEN 'paid' ELSE 'cancelled' END WHEN 'kitchen.status' THEN 'new → preparing' WHEN 'stock.purchase' THEN '10 → ' || CAST(k AS VARCHAR) || ' g' WHEN 'staff.create' THEN 'role: admin'
 ELSE 'category: A → B; price: ₹' || CAST(k AS VARCHAR) || ' → ₹12' END AS summary FROM ad""",
)


@query("audit_render", "SELECT * FROM rd", **AUDIT_DOCS)
def audit_render(t):
    return D.render(t.audit_documents, SHOP.currency).select("id", "action", "entity_id", "created_at", "label", "target", "summary")


@query("audit_page", "SELECT id, action, entity_id, created_at FROM pos_audit_log WHERE action LIKE 'stock.%' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def audit_page(t):
    return P.audit_page(t.audit, "stock", None, 50, 50).select("id", "action", "entity_id", "created_at")


@query("audit_feed", "SELECT * FROM rd WHERE action LIKE 'menu.%' ORDER BY created_at DESC, id DESC LIMIT 50", **AUDIT_DOCS)
def audit_feed(t):
    """A page of the audit log: cut first, rendered after."""
    return D.render(P.audit_page(t.audit_documents, "menu", None, 50), SHOP.currency).select("id", "action", "entity_id", "created_at", "label", "target", "summary")
