"""Coupon pricing, limits and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog.params import AS_OF, AS_OF_SQL, DAY, SHOP
from tillworks.catalog.registry import query
from tillworks.config import stage_table
from tillworks.operators import coupons as C
from tillworks.sources import payloads

A = "DECIMAL(18,2)"

# Pricing as CTEs over (bills b, lines l); each check inlines what it needs.
PRICING = dict(
    bm="""SELECT b.id, b.phone, b.created_at, b.payment_status, upper(trim(coalesce(b.code, ''))) AS code, c.id AS coupon_id, c.kind, c.value, c.max_discount, c.min_bill, c.buy_qty, c.get_qty,
 c.applies_to, c.item_ids, c.categories, c.valid_from, c.valid_to, c.usage_limit, c.per_customer_limit, c.is_active
 FROM b LEFT JOIN pos_coupons c ON upper(c.code) = upper(trim(coalesce(b.code, '')))""",
    cl="""SELECT q.order_id, bm.coupon_id, q.menu_item_id, m.price, q.qty, bm.applies_to = 'all' OR list_contains(bm.item_ids, q.menu_item_id) OR list_contains(bm.categories, m.category) AS eligible
 FROM (SELECT order_id, menu_item_id, CAST(sum(qty) AS BIGINT) AS qty FROM l WHERE qty > 0 GROUP BY 1, 2) q JOIN pos_menu_items m ON m.id = q.menu_item_id AND m.is_active
 JOIN bm ON bm.id = q.order_id AND bm.coupon_id IS NOT NULL""",
    su=f"""SELECT order_id, CAST(sum(price * qty) AS {A}) AS subtotal, CAST(coalesce(sum(price * qty) FILTER (eligible), 0) AS {A}) AS eligible_amount,
 CAST(coalesce(sum(qty) FILTER (eligible), 0) AS BIGINT) AS eligible_units FROM cl GROUP BY 1""",
    fr="""SELECT order_id, price, greatest(least((total_units // (buy_qty + get_qty)) * get_qty - before, qty), 0) AS free FROM
 (SELECT cl.order_id, cl.price, cl.qty, bm.buy_qty, bm.get_qty, sum(cl.qty) OVER (PARTITION BY cl.order_id) AS total_units,
 sum(cl.qty) OVER (PARTITION BY cl.order_id ORDER BY cl.price, cl.menu_item_id ROWS UNBOUNDED PRECEDING) - cl.qty AS before FROM cl JOIN bm ON bm.id = cl.order_id AND bm.kind = 'bogo' WHERE cl.eligible)""",
    bo=f"SELECT order_id, CAST(sum(free) AS BIGINT) AS free_units, CAST(sum(price * free) AS {A}) AS bogo_discount FROM fr GROUP BY 1",
    pr=f"""SELECT *, least(CAST(CASE kind WHEN 'percent' THEN round(eligible_amount * value * CAST(0.01 AS DECIMAL(3,2)), 2) WHEN 'flat' THEN least(value, eligible_amount) ELSE bogo_discount END AS {A}),
 coalesce(CAST(max_discount AS {A}), 999999999), subtotal) AS discount FROM (SELECT bm.*, coalesce(su.subtotal, 0) AS subtotal, coalesce(su.eligible_amount, 0) AS eligible_amount, coalesce(su.eligible_units, 0) AS eligible_units,
 coalesce(bo.free_units, 0) AS free_units, bo.bogo_discount FROM bm LEFT JOIN su ON su.order_id = bm.id LEFT JOIN bo ON bo.order_id = bm.id)""",
)
BATCH = dict(b="SELECT * FROM pos_coupon_bills", l="SELECT order_id, menu_item_id, qty FROM pos_order_items", **PRICING)
EARLY = """CASE WHEN code = '' THEN 'no code' WHEN coupon_id IS NULL THEN 'unknown' WHEN NOT is_active THEN 'off' WHEN {today} < valid_from THEN 'not started' WHEN {today} > valid_to THEN 'expired'
 WHEN subtotal < min_bill THEN 'below minimum' WHEN eligible_units = 0 THEN 'nothing covered' END"""
LATE = """CASE WHEN early IS NOT NULL THEN early WHEN used >= usage_limit THEN 'used up' WHEN per_customer_limit IS NOT NULL AND phone IS NULL THEN 'needs phone'
 WHEN mine >= per_customer_limit THEN 'customer limit' WHEN kind = 'bogo' AND free_units = 0 THEN 'too few items' END"""
QUOTED = f"""SELECT id, code, coupon_id, CASE WHEN coupon_id IS NOT NULL THEN subtotal END AS subtotal, CASE WHEN reason IS NULL THEN CAST(discount AS {A}) END AS discount,
 CASE WHEN reason IS NULL THEN CAST(subtotal - discount AS {A}) END AS total, reason FROM q"""
PAST = dict(
    us="SELECT coupon_id, count(*) AS n FROM pos_orders WHERE coupon_id IS NOT NULL AND payment_status <> 'cancelled' GROUP BY 1",
    cu="SELECT coupon_id, phone, count(*) AS n FROM pos_orders WHERE coupon_id IS NOT NULL AND phone IS NOT NULL AND payment_status <> 'cancelled' GROUP BY 1, 2",
)


def quoted(today: str) -> dict[str, str]:
    return dict(
        e=f"SELECT *, {EARLY.format(today=today)} AS early FROM (SELECT pr.*, coalesce(us.n, 0) AS used, coalesce(cu.n, 0) AS mine FROM pr LEFT JOIN us ON us.coupon_id = pr.coupon_id LEFT JOIN cu ON cu.coupon_id = pr.coupon_id AND cu.phone = pr.phone)",
        q=f"SELECT *, {LATE} AS reason FROM e",
    )


def batch(t):
    return t.coupon_bills, t.order_lines, t.coupons, t.menu


@query("coupon_eligibility", "SELECT order_id, coupon_id, menu_item_id, price, qty, eligible FROM cl", **BATCH)
def coupon_eligibility(t):
    return C.coupon_lines(*batch(t))


@query("coupon_line_sums", "SELECT * FROM su", **BATCH)
def coupon_line_sums(t):
    return C.line_sums(C.price_levels(C.coupon_lines(*batch(t))))


@query("bogo_cheapest_units", "SELECT order_id, price, CAST(sum(free) AS BIGINT) AS free FROM fr GROUP BY 1, 2", **BATCH)
def bogo_cheapest_units(t):
    levels = C.price_levels(C.coupon_lines(*batch(t)))
    return C.free_units(levels, _offers(t))


def _offers(t):
    matched = C.match_coupons(t.coupon_bills, t.coupons).filter("c_kind = 'bogo'")
    return matched.select(F.col("id").alias("order_id"), F.col("c_buy_qty").alias("buy_qty"), F.col("c_get_qty").alias("get_qty"))


@query("unit_explode", "SELECT order_id, price, CAST(sum(qty) AS BIGINT) AS units FROM cl WHERE eligible AND order_id % 12 IN (5, 6) GROUP BY 1, 2", **BATCH)
def unit_explode(t):
    """Unit counts per price level: the compact form of one row per unit."""
    offers = _offers(t).select("order_id")
    return C.price_levels(C.coupon_lines(*batch(t))).filter("eligible").join(offers, "order_id", "left_semi").select("order_id", "price", "units")


def _kind(kind: str, columns: str):
    sql = f"SELECT id, {columns} FROM pr WHERE kind = '{kind}' AND eligible_units > 0"

    def plan(t):
        rows = C.priced_bills(*batch(t)).filter((F.col("c_kind") == kind) & (F.col("eligible_units") > 0))
        if kind == "percent":
            raw = C.percent_discount(F.col("eligible_amount"), F.col("c_value"))
        elif kind == "flat":
            raw = C.flat_discount(F.col("eligible_amount"), F.col("c_value"))
        else:
            raw = F.col("bogo_discount")
        return rows.select("id", "eligible_amount", raw.alias("raw_discount"))

    query(f"coupon_{kind}", sql, **BATCH)(plan)


_kind("percent", f"eligible_amount, CAST(round(eligible_amount * value * CAST(0.01 AS DECIMAL(3,2)), 2) AS {A}) AS raw_discount")
_kind("flat", f"eligible_amount, CAST(least(value, eligible_amount) AS {A}) AS raw_discount")
_kind("bogo", "eligible_amount, bogo_discount AS raw_discount")


@query("coupon_caps", f"SELECT id, coupon_id, CAST(discount AS {A}) AS discount FROM pr WHERE eligible_units > 0", **BATCH)
def coupon_caps(t):
    return C.priced_bills(*batch(t)).filter("eligible_units > 0").select("id", "coupon_id", "discount")


@query("coupon_quote", QUOTED, **BATCH, **PAST, **quoted(DAY))
def coupon_quote(t):
    return C.quote(*batch(t), past=t.orders)


PREVIEW = dict(
    b="""SELECT p.id, p.phone, x.created_at, 'paid' AS payment_status, x.coupon_code AS code FROM pos_bills x JOIN (SELECT id, nullif(regexp_replace(coalesce(phone, ''), '\\D', '', 'g'), '') AS phone FROM pos_bills) p ON p.id = x.id
 WHERE (p.phone IS NULL OR regexp_full_match(p.phone, '[0-9]{10}')) AND json_type(x.items) = 'ARRAY' AND json_array_length(x.items) > 0""",
    l="SELECT bill_id AS order_id, menu_item_id, qty FROM pos_bill_lines",
    **PRICING,
)


@query("coupon_preview", QUOTED, **PREVIEW, **PAST, **quoted(f"CAST({AS_OF_SQL} + INTERVAL '330' MINUTE AS DATE)"))
def coupon_preview(t):
    from tillworks.plans.bills import preview_input

    bills = preview_input(t.bills)
    lines = payloads.explode_bill_items(t.bills).withColumnRenamed("bill_id", "order_id")
    return C.quote(bills, lines, t.coupons, t.menu, past=t.orders, as_of=AS_OF)


SETTLE = dict(
    **BATCH,
    e=f"""SELECT *, {EARLY.format(today=DAY)} AS early, CASE WHEN NOT (kind = 'bogo' AND free_units = 0) AND (per_customer_limit IS NULL OR phone IS NOT NULL) AND payment_status <> 'cancelled' THEN 1 ELSE 0 END AS ok FROM pr""",
    r1="""SELECT *, CASE WHEN per_customer_limit IS NOT NULL AND phone IS NOT NULL THEN coalesce(sum(ok) OVER (PARTITION BY coupon_id, phone ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS mine FROM e WHERE early IS NULL""",
    r2="""SELECT *, coalesce(sum(CASE WHEN per_customer_limit IS NULL OR mine < per_customer_limit THEN ok ELSE 0 END) OVER (PARTITION BY coupon_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r1""",
    q=f"""SELECT id, code, coupon_id, subtotal, discount, {LATE} AS reason FROM r2 UNION ALL SELECT id, code, coupon_id, subtotal, discount, early FROM e WHERE early IS NOT NULL""",
)


@query("coupon_settlement", QUOTED, **SETTLE)
def coupon_settlement(t):
    return C.settlement(*batch(t))


@query("coupon_limit_rank", "SELECT id, coupon_id, CAST(mine AS BIGINT) AS before_customer, CAST(used AS BIGINT) AS before_coupon FROM r2", **SETTLE)
def coupon_limit_rank(t):
    return C.limit_ranks(stage_table(C.priced_bills(*batch(t)))).select("id", "coupon_id", F.col("_mine").alias("before_customer"), F.col("_used").alias("before_coupon"))


# ---- limits over stored bills and cancellations, bill by bill ---------------

STORED = dict(
    **{**BATCH, "b": "SELECT * FROM pos_coupon_bills WHERE id % 3 <> 0"},
    cx="SELECT id, created_at + INTERVAL '1' DAY * (1 + id % 30) AS at FROM pos_orders WHERE payment_status = 'cancelled'",
    sx="SELECT o.coupon_id, o.phone, o.created_at, cx.at AS gone FROM pos_orders o LEFT JOIN cx ON cx.id = o.id WHERE o.id % 3 = 0 AND o.coupon_id IS NOT NULL",
    e=f"SELECT *, {EARLY.format(today=DAY)} AS early FROM pr",
    x="SELECT e.*, cx.at AS gone, (kind = 'bogo' AND free_units = 0) OR (per_customer_limit IS NOT NULL AND phone IS NULL) AS failing FROM e LEFT JOIN cx ON cx.id = e.id WHERE early IS NULL AND (usage_limit IS NOT NULL OR per_customer_limit IS NOT NULL)",
    t="""SELECT row_number() OVER (ORDER BY created_at, id) AS n, * FROM (SELECT x.id, x.coupon_id, x.phone, x.created_at, x.gone, x.usage_limit, x.per_customer_limit, x.failing,
 count(sx.coupon_id) AS s_used, count(sx.coupon_id) FILTER (sx.phone = x.phone) AS s_mine FROM x LEFT JOIN sx ON sx.coupon_id = x.coupon_id AND sx.created_at <= x.created_at AND (sx.gone IS NULL OR sx.gone > x.created_at) GROUP BY ALL)""",
    rc="""SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS mine, CAST([] AS STRUCT(c BIGINT, p VARCHAR, u TIMESTAMP)[]) AS held
 UNION ALL SELECT n, id, used, mine, CASE WHEN NOT failing AND coalesce(used < usage_limit, true) AND coalesce(mine < per_customer_limit, true) THEN list_append(held, {'c': CAST(coupon_id AS BIGINT), 'p': phone, 'u': gone}) ELSE held END FROM
 (SELECT t.*, rc.held, t.s_used + len(list_filter(rc.held, lambda h: h.c = t.coupon_id AND (h.u IS NULL OR h.u > t.created_at))) AS used,
 t.s_mine + len(list_filter(rc.held, lambda h: h.c = t.coupon_id AND h.p = t.phone AND (h.u IS NULL OR h.u > t.created_at))) AS mine FROM rc JOIN t ON t.n = rc.n + 1)""",
    q=f"SELECT e.id, code, coupon_id, subtotal, discount, {LATE} AS reason FROM e LEFT JOIN rc ON rc.id = e.id",
)


def cancellations(t, sign: int = 1):
    """When cancelled bills were cancelled: 1 to 30 days after they were made."""
    gone = t.orders.filter("payment_status = 'cancelled'")
    return gone.select((sign * F.col("id")).alias("id"), F.timestamp_add("DAY", (1 + F.col("id") % 30).cast("int"), F.col("created_at")).alias("at"))


@query("coupon_settlement_stored", QUOTED, **STORED)
def coupon_settlement_stored(t):
    """Two thirds of the bills settled against the coupon uses of the others, which are stored."""
    bills = t.coupon_bills.filter("id % 3 <> 0")
    return C.settlement_over_time(bills, t.order_lines, t.coupons, t.menu, t.orders.filter("id % 3 = 0"), cancellations(t))


@query(
    "coupon_uses",
    """SELECT 'coupon' AS kind, coupon_id, NULL AS phone, count(*) AS uses, CAST(sum(discount) AS DECIMAL(24,2)) AS given FROM pos_orders WHERE coupon_id IS NOT NULL AND payment_status <> 'cancelled' GROUP BY 2
 UNION ALL SELECT 'customer', coupon_id, phone, count(*), NULL FROM pos_orders WHERE coupon_id IS NOT NULL AND phone IS NOT NULL AND payment_status <> 'cancelled' GROUP BY 2, 3""",
)
def coupon_uses(t):
    per_coupon = C.coupon_uses(t.orders).select(F.lit("coupon").alias("kind"), "coupon_id", F.lit(None).cast("string").alias("phone"), "uses", "given")
    per_customer = C.customer_uses(t.orders).select(F.lit("customer").alias("kind"), "coupon_id", "phone", "uses", F.lit(None).cast("decimal(24,2)").alias("given"))
    return per_coupon.unionByName(per_customer)


USES = dict(u="SELECT coupon_id, count(*) AS uses, sum(discount) AS given FROM pos_orders WHERE coupon_id IS NOT NULL AND payment_status <> 'cancelled' GROUP BY 1")
STATE = """CASE WHEN NOT is_active THEN 'off' WHEN DATE '1998-07-01' > valid_to THEN 'expired' WHEN coalesce(uses, 0) >= usage_limit THEN 'used up' WHEN DATE '1998-07-01' < valid_from THEN 'scheduled' ELSE 'active' END"""


@query("coupon_usage_join", "SELECT id, code, coalesce(uses, 0) AS uses, CAST(coalesce(given, 0) AS DECIMAL(24,2)) AS discount_given FROM pos_coupons LEFT JOIN u ON u.coupon_id = id", **USES)
def coupon_usage_join(t):
    return _catalogue(t).select("id", "code", "uses", "discount_given")


def _catalogue(t):
    return C.catalogue(t.coupons, t.orders, AS_OF, SHOP.currency)


@query("coupon_status", f"SELECT id, code, {STATE} AS state FROM pos_coupons LEFT JOIN u ON u.coupon_id = id", **USES)
def coupon_status(t):
    return _catalogue(t).select("id", "code", "state")


OFFER = """concat_ws(' · ', CASE kind WHEN 'percent' THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) WHEN 'flat' THEN '₹' || CAST(value AS VARCHAR) || ' off' ELSE 'Buy ' || CAST(buy_qty AS VARCHAR) || ' get ' || CAST(get_qty AS VARCHAR) || ' free' END,
 CASE WHEN max_discount IS NOT NULL THEN 'up to ₹' || CAST(max_discount AS VARCHAR) END, CASE WHEN min_bill > 0 THEN 'min bill ₹' || CAST(min_bill AS VARCHAR) END)"""
OFFER = OFFER.replace("CAST(CAST(value AS DOUBLE) AS VARCHAR)", "rtrim(rtrim(CAST(value AS VARCHAR), '0'), '.') || '% off'")
VALIDITY = """CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN 'Always' WHEN valid_from IS NULL THEN 'Until ' || strftime(valid_to, '%-d %b %Y') WHEN valid_to IS NULL THEN 'From ' || strftime(valid_from, '%-d %b %Y')
 ELSE strftime(valid_from, '%-d %b %Y') || ' – ' || strftime(valid_to, '%-d %b %Y') END"""


@query(
    "coupon_catalogue",
    f"SELECT id, code, is_active, created_at, coalesce(uses, 0) AS uses, CAST(coalesce(given, 0) AS DECIMAL(24,2)) AS discount_given, {STATE} AS state, {OFFER} AS offer, {VALIDITY} AS validity FROM pos_coupons LEFT JOIN u ON u.coupon_id = id",
    **USES,
)
def coupon_catalogue(t):
    return _catalogue(t)


SCOPE = """SELECT c.id, c.code, CASE WHEN c.applies_to = 'all' THEN 'Whole bill' ELSE array_to_string(list_slice(n.names, 1, 3), ', ') || CASE WHEN len(n.names) > 3 THEN ' +' || CAST(len(n.names) - 3 AS VARCHAR) || ' more' ELSE '' END END AS scope
 FROM pos_coupons c JOIN n ON n.id = c.id"""
NAMES = """SELECT c.id, list_concat(list_transform(c.categories, lambda x: x || ' (category)'), coalesce((SELECT list(coalesce(m.name, '#' || CAST(i.item AS VARCHAR) || ' (deleted)') ORDER BY i.pos) FROM
 (SELECT c2.id, unnest(c2.item_ids) AS item, generate_subscripts(c2.item_ids, 1) AS pos FROM pos_coupons c2) i LEFT JOIN pos_menu_items m ON m.id = i.item WHERE i.id = c.id), CAST([] AS VARCHAR[]))) AS names FROM pos_coupons c"""


@query("coupon_labels", SCOPE, n=NAMES)
def coupon_labels(t):
    return C.scope_labels(t.coupons, t.menu)


@query(
    "id_list_lookup",
    """SELECT 'coupon' AS kind, i.id AS owner, CAST(i.pos - 1 AS INTEGER) AS pos, coalesce(m.name, '#' || CAST(i.item AS VARCHAR) || ' (deleted)') AS name FROM (SELECT id, unnest(item_ids) AS item, generate_subscripts(item_ids, 1) AS pos FROM pos_coupons) i LEFT JOIN pos_menu_items m ON m.id = i.item
 UNION ALL SELECT 'order', b.bill_id, CAST(b.line_no AS INTEGER), m.name FROM pos_bill_lines b JOIN pos_menu_items m ON m.id = b.menu_item_id AND m.is_active""",
)
def id_list_lookup(t):
    """Id lists to names: deleted ids of a coupon stay, marked; missing items of a bill drop out."""
    names = t.menu.select(F.col("id").alias("item_id"), "name", "is_active")
    ids = t.coupons.select(F.lit("coupon").alias("kind"), F.col("id").alias("owner"), F.posexplode("item_ids").alias("pos", "item_id"))
    marked = ids.join(names, "item_id", "left").select("kind", "owner", "pos", F.coalesce("name", F.concat(F.lit("#"), F.col("item_id").cast("string"), F.lit(" (deleted)"))).alias("name"))
    lines = payloads.explode_bill_items(t.bills).select(F.lit("order").alias("kind"), F.col("bill_id").alias("owner"), F.col("line_no").cast("int").alias("pos"), F.col("menu_item_id").alias("item_id"))
    found = lines.join(names.filter("is_active"), "item_id").select("kind", "owner", "pos", "name")
    return marked.unionByName(found)
