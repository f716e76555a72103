"""Requests at the desk: payments, stock inputs, shifts, deletes, and the audit rows they leave.

The check texts go through the requests one by one, which the plans never do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog import coupon_queries as CQ
from tillworks.catalog import job_queries as JQ
from tillworks.catalog import scalar_queries as SQ
from tillworks.catalog.board_queries import AS_OF, NEED, lanes, needs, snapshots, SNAP
from tillworks.catalog.params import SHOP
from tillworks.catalog.registry import query
from tillworks.functions import messages
from tillworks.operators import coupons as C
from tillworks.operators import diff as D
from tillworks.operators import kitchen as K
from tillworks.operators import maintain as M
from tillworks.operators import payments as PAY
from tillworks.operators import shifts as H
from tillworks.operators import stock as S

MONEY, Q24 = "DECIMAL(24,2)", "DECIMAL(24,3)"


# ---- payments -------------------------------------------------------------


def payment_requests(t):
    """Every event as a request for the bill of its user's number; some name no bill, method or status there is."""
    e, kind = F.col("event_id"), F.col("event_type")
    pays = kind.isin("purchase", "click")
    method = F.when(e % 6 == 0, " UPI ").when(e % 6 == 1, "card").when(e % 6 == 2, " ").when(e % 31 == 0, "cheque")
    status = F.when(e % 29 == 0, "refunded").when(kind == "view", "pending").when(kind == "signup", "cancelled").otherwise("paid")
    return t.raw("events").select(
        e.alias("id"), (F.col("user_id") * 7 - F.when(e % 37 == 0, 1_000_000).otherwise(0)).alias("order_id"),
        F.when(pays, "pay").otherwise("status").alias("kind"), F.when(pays, method).otherwise(status).alias("value"), F.col("ts").alias("created_at"),
    )


def paid_orders(t):
    return t.orders.withColumn("paid_at", F.when(F.col("payment_status") == "paid", F.col("created_at")))


PAYMENTS = dict(
    rq="""SELECT event_id AS id, user_id * 7 - CASE WHEN event_id % 37 = 0 THEN 1000000 ELSE 0 END AS order_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'pay' ELSE 'status' END AS kind,
 CASE WHEN event_type IN ('purchase', 'click') THEN CASE WHEN event_id % 6 = 0 THEN 'upi' WHEN event_id % 6 = 1 THEN 'card' WHEN event_id % 6 = 2 THEN NULL WHEN event_id % 31 = 0 THEN 'cheque' END
 ELSE CASE WHEN event_id % 29 = 0 THEN 'refunded' WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'signup' THEN 'cancelled' ELSE 'paid' END END AS value, ts AS created_at FROM events""",
    er=f"""SELECT rq.*, o.total, CASE WHEN kind = 'pay' AND value = 'cheque' THEN '{messages.BAD_METHOD}' WHEN kind = 'status' AND value = 'refunded' THEN '{messages.BAD_STATUS}' WHEN o.id IS NULL THEN '{messages.NO_ORDER}' END AS e
 FROM rq LEFT JOIN pos_orders o ON o.id = rq.order_id""",
    t="SELECT row_number() OVER (PARTITION BY order_id ORDER BY created_at, id) AS n, * FROM er WHERE e IS NULL",
    rc=f"""SELECT CAST(0 AS BIGINT) AS n, id AS order_id, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS old, payment_status AS st, payment_method AS method, CASE WHEN payment_status = 'paid' THEN created_at END AS paid_at, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS kind FROM pos_orders
 UNION ALL SELECT t.n, t.order_id, t.id, rc.st, CASE WHEN t.kind = 'status' THEN t.value WHEN rc.st = 'pending' THEN 'paid' ELSE rc.st END,
 CASE WHEN t.kind = 'pay' AND rc.st = 'pending' THEN coalesce(t.value, rc.method) ELSE rc.method END,
 CASE WHEN t.kind = 'pay' THEN CASE WHEN rc.st = 'pending' THEN t.created_at ELSE rc.paid_at END WHEN t.value = rc.st OR t.value = 'cancelled' THEN rc.paid_at WHEN t.value = 'paid' THEN coalesce(rc.paid_at, t.created_at) END,
 CASE WHEN t.kind = 'pay' AND rc.st = 'cancelled' THEN '{messages.NOT_PENDING}' END, t.kind FROM rc JOIN t ON t.n = rc.n + 1 AND t.order_id = rc.order_id""",
)


@query("payment_requests", "SELECT id, order_id, old, CASE WHEN error IS NULL THEN st END AS new, error FROM rc WHERE n > 0 UNION ALL SELECT id, order_id, NULL, NULL, e FROM er WHERE e IS NOT NULL", **PAYMENTS)
def payment_requests_decided(t):
    """Each request: the bill's status before and after, or why it is refused."""
    return PAY.decide(payment_requests(t), t.orders).select("id", "order_id", "old", "new", "error")


@query("payment_requests_orders", "SELECT order_id AS id, max_by(st, n) AS payment_status, max_by({'m': method}, n).m AS payment_method, max_by({'p': paid_at}, n).p AS paid_at FROM rc GROUP BY 1", **PAYMENTS)
def payment_requests_orders(t):
    return PAY.orders_after(paid_orders(t), PAY.decide(payment_requests(t), t.orders)).select("id", "payment_status", "payment_method", "paid_at")


@query(
    "payment_requests_audit",
    """SELECT rc.id, CASE WHEN rc.kind = 'pay' THEN 'order.paid' ELSE 'order.status' END AS action, CAST(rc.order_id AS VARCHAR) AS entity_id,
 CASE WHEN rc.kind = 'pay' THEN '{"method":' || coalesce('"' || rc.method || '"', 'null') || ',"total":' || CAST(er.total AS VARCHAR) || '}' ELSE '{"from":"' || rc.old || '","to":"' || rc.st || '"}' END AS details
 FROM rc JOIN er ON er.id = rc.id WHERE rc.error IS NULL AND rc.old <> rc.st""",
    **PAYMENTS,
)
def payment_requests_audit(t):
    return PAY.audit(PAY.decide(payment_requests(t), t.orders)).select("id", "action", "entity_id", "details")


# ---- stock inputs ---------------------------------------------------------


def typed_inputs(t):
    """Every event as an input at the stock desk, with the mistakes a form lets through."""
    e, kind = F.col("event_id"), F.col("event_type")
    value = F.col("value").cast("decimal(14,3)")
    return t.raw("events").select(
        e.alias("id"), (F.col("user_id") % 110 - F.when(e % 41 == 0, 500).otherwise(0)).alias("ingredient_id"),
        F.when(kind == "view", "waste").when(kind == "signup", "count").when(kind == "error", F.when(e % 9 == 0, "sale").otherwise("waste")).otherwise("purchase").alias("kind"),
        F.when(e % 19 == 0, F.lit(None)).when(e % 23 == 0, -value).when(e % 27 == 0, value * 0).otherwise(value).cast("decimal(14,3)").alias("qty"),
        F.when(e % 43 == 0, F.repeat(F.lit("x"), 201)).when(e % 2 == 0, F.lit(" by hand ")).when(e % 3 == 0, F.lit("  ")).alias("note"), F.col("ts").alias("created_at"),
    )


INPUTS = dict(
    iq="""SELECT event_id AS id, user_id % 110 - CASE WHEN event_id % 41 = 0 THEN 500 ELSE 0 END AS ingredient_id, CASE event_type WHEN 'view' THEN 'waste' WHEN 'signup' THEN 'count' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'sale' ELSE 'waste' END ELSE 'purchase' END AS kind,
 CAST(CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN -CAST(value AS DECIMAL(14,3)) WHEN event_id % 27 = 0 THEN 0 ELSE CAST(value AS DECIMAL(14,3)) END AS DECIMAL(14,3)) AS qty,
 CASE WHEN event_id % 43 = 0 THEN repeat('x', 201) WHEN event_id % 2 = 0 THEN 'by hand' END AS note, ts AS created_at FROM events""",
    ie=f"""SELECT iq.*, g.name, g.unit, CASE WHEN kind = 'sale' THEN '{messages.BAD_STOCK_KIND}' WHEN kind = 'count' AND (qty IS NULL OR qty < 0) THEN '{messages.BAD_COUNT}' WHEN kind <> 'count' AND (qty IS NULL OR qty <= 0) THEN '{messages.BAD_QUANTITY}'
 WHEN length(note) > 200 THEN '{messages.LONG_NOTE}' WHEN g.id IS NULL THEN '{messages.NO_INGREDIENT}' END AS error FROM iq LEFT JOIN pos_ingredients g ON g.id = iq.ingredient_id""",
    t="SELECT row_number() OVER (PARTITION BY ingredient_id ORDER BY created_at, id) AS n, * FROM ie WHERE error IS NULL",
    rc=f"""SELECT CAST(0 AS BIGINT) AS n, id AS ingredient_id, CAST(NULL AS BIGINT) AS id, CAST(NULL AS {Q24}) AS b, CAST(stock AS {Q24}) AS a, track_stock AS tracked FROM pos_ingredients
 UNION ALL SELECT t.n, t.ingredient_id, t.id, rc.a, CAST(CASE t.kind WHEN 'purchase' THEN rc.a + t.qty WHEN 'waste' THEN rc.a - t.qty ELSE t.qty END AS {Q24}), true FROM rc JOIN t ON t.n = rc.n + 1 AND t.ingredient_id = rc.ingredient_id""",
)


@query("stock_inputs", "SELECT ie.id, ie.ingredient_id, ie.kind, ie.qty, ie.error, rc.b AS before, rc.a AS after FROM ie LEFT JOIN rc ON rc.id = ie.id", **INPUTS)
def stock_inputs(t):
    return S.stock_inputs(typed_inputs(t), t.ingredients).select("id", "ingredient_id", "kind", "qty", "error", "before", "after")


@query("stock_inputs_ingredients", "SELECT ingredient_id AS id, max_by(a, n) AS stock, max_by(tracked, n) AS track_stock FROM rc GROUP BY 1", **INPUTS)
def stock_inputs_ingredients(t):
    return S.ingredients_after(t.ingredients, S.stock_inputs(typed_inputs(t), t.ingredients)).select("id", "stock", "track_stock")


@query(
    "stock_inputs_audit",
    """SELECT ie.id, 'stock.' || kind AS action, CAST(ie.ingredient_id AS VARCHAR) AS entity_id, '{"name":"' || name || '","unit":"' || unit || '","qty":' || CAST(qty AS VARCHAR) || ',"before":' || CAST(b AS VARCHAR) || ',"after":' || CAST(a AS VARCHAR)
 || ',"note":' || coalesce('"' || note || '"', 'null') || '}' AS details FROM ie JOIN rc ON rc.id = ie.id""",
    **INPUTS,
)
def stock_inputs_audit(t):
    return S.input_audit(S.stock_inputs(typed_inputs(t), t.ingredients))


# ---- shifts ---------------------------------------------------------------


def stored_shifts(t):
    """The monthly shifts under numbers of their own; those of the first month may still be open."""
    open_ = F.col("closed_at").isNull() & (F.col("id") % 1_000_000 == 199_501)
    end = F.when(~open_, F.coalesce("closed_at", F.timestamp_add("HOUR", F.lit(12), F.col("opened_at"))))
    return t.shifts.withColumn("closed_at", end).withColumn("id", -F.col("id"))


def shift_requests(t):
    """Every bill with an author as a request of that author: open a shift, close one's own, or close one by number."""
    k = F.col("id")
    close = F.when(k % 11 == 0, -(F.col("created_by") * 1_000_000 + 199_501)).when(k % 6 == 1, k - 1)
    return t.orders.filter("created_by is not null").select(
        k, F.col("created_by").alias("admin_id"), F.when(k % 3 == 0, "open").otherwise("close").alias("kind"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, -1).otherwise(k % 1000).cast("decimal(10,2)").alias("cash"),
        F.when(k % 23 == 0, F.repeat(F.lit("x"), 201)).when(k % 2 == 0, F.lit(" end of day ")).alias("note"),
        F.when(k % 3 != 0, close).alias("target"), "created_at",
    )


SHIFTS = dict(
    s0="SELECT -id AS id, admin_id, opened_at, CASE WHEN closed_at IS NULL AND id % 1000000 = 199501 THEN NULL ELSE coalesce(closed_at, opened_at + INTERVAL '12' HOUR) END AS closed_at, opening_cash, closed_by, counted_cash FROM pos_shifts",
    q0="""SELECT id, created_by AS admin_id, CASE WHEN id % 3 = 0 THEN 'open' ELSE 'close' END AS kind, CAST(CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN -1 ELSE id % 1000 END AS DECIMAL(10,2)) AS cash,
 CASE WHEN id % 23 = 0 THEN repeat('x', 201) WHEN id % 2 = 0 THEN 'end of day' END AS note, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 11 = 0 THEN -(created_by * 1000000 + 199501) WHEN id % 6 = 1 THEN id - 1 END END AS target, created_at FROM pos_orders WHERE created_by IS NOT NULL""",
    ow="SELECT id, admin_id AS owner FROM q0 WHERE kind = 'open' UNION ALL SELECT id, admin_id FROM s0",
    q="""SELECT q0.*, coalesce(a.role = 'super', false) AS super, CASE WHEN target IS NULL THEN q0.admin_id ELSE ow.owner END AS account FROM q0 LEFT JOIN pos_admins a ON a.id = q0.admin_id LEFT JOIN ow ON ow.id = q0.target""",
    t=f"""SELECT row_number() OVER (PARTITION BY account ORDER BY created_at, id) AS n, *, CASE WHEN cash IS NULL OR cash < 0 THEN CASE WHEN kind = 'open' THEN '{messages.BAD_OPENING_CASH}' ELSE '{messages.BAD_COUNTED_CASH}' END
 WHEN kind = 'close' AND length(note) > 200 THEN '{messages.LONG_NOTE}' END AS bad FROM q WHERE account IS NOT NULL""",
    rc=f"""SELECT CAST(0 AS BIGINT) AS n, account, CAST(NULL AS BIGINT) AS id, (SELECT min(s0.id) FROM s0 WHERE s0.admin_id = x.account AND closed_at IS NULL) AS cur, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS shift_id FROM (SELECT DISTINCT account FROM t) x
 UNION ALL SELECT n, account, id, CASE WHEN error IS NOT NULL THEN cur WHEN kind = 'open' THEN id END, error, CASE WHEN error IS NULL THEN CASE WHEN kind = 'open' THEN id ELSE cur END END FROM
 (SELECT t.n, t.account, t.id, t.kind, rc.cur, CASE WHEN t.kind = 'open' THEN CASE WHEN t.bad IS NOT NULL THEN t.bad WHEN rc.cur IS NOT NULL THEN '{messages.OPEN_ALREADY}' END
 WHEN t.target IS NULL THEN CASE WHEN rc.cur IS NULL THEN '{messages.NONE_OPEN}' ELSE t.bad END WHEN rc.cur IS DISTINCT FROM t.target THEN 'gone' WHEN t.account <> t.admin_id AND NOT t.super THEN '{messages.SUPER_ONLY}' ELSE t.bad END AS error FROM rc JOIN t ON t.n = rc.n + 1 AND t.account = rc.account)""",
    ef="SELECT q.id, q.created_at FROM rc JOIN q ON q.id = rc.id WHERE rc.error IS NULL AND q.kind = 'open'",
    dc=f"""SELECT q.*, rc.shift_id, CASE WHEN rc.error <> 'gone' OR (rc.id IS NOT NULL AND rc.error IS NULL) THEN rc.error
 WHEN q.target NOT IN (SELECT id FROM s0) AND NOT EXISTS (SELECT 1 FROM ef WHERE ef.id = q.target AND (ef.created_at < q.created_at OR (ef.created_at = q.created_at AND ef.id < q.id))) THEN '{messages.NO_SHIFT}'
 WHEN q.account IS DISTINCT FROM q.admin_id AND NOT q.super THEN '{messages.SUPER_ONLY}' ELSE '{messages.SHIFT_CLOSED}' END AS error FROM q LEFT JOIN rc ON rc.id = q.id""",
    sh="""SELECT s.id, s.admin_id, s.opened_at, coalesce(c.created_at, s.closed_at) AS closed_at, coalesce(c.admin_id, s.closed_by) AS closed_by, s.opening_cash, coalesce(c.cash, s.counted_cash) AS counted_cash, c.note, c.id IS NOT NULL AS now
 FROM (SELECT id, admin_id, opened_at, closed_at, opening_cash, closed_by, counted_cash FROM s0 UNION ALL SELECT id, admin_id, created_at, NULL, cash, NULL, NULL FROM dc WHERE kind = 'open' AND error IS NULL) s
 LEFT JOIN dc c ON c.kind = 'close' AND c.error IS NULL AND c.shift_id = s.id""",
    sm=f"""SELECT sh.id, count(o.id) FILTER (payment_status = 'paid') AS orders, {', '.join(f"CAST(coalesce(sum(o.total) FILTER ({c}), 0) AS {MONEY}) AS {n}" for n, c in (('sales', "payment_status = 'paid'"), *((m, f"payment_status = 'paid' AND payment_method = '{m}'") for m in ('cash', 'upi', 'card')), ('pending_total', "payment_status = 'pending'"), ('cancelled_total', "payment_status = 'cancelled'")))},
 count(o.id) FILTER (payment_status = 'pending') AS pending_count, count(o.id) FILTER (payment_status = 'cancelled') AS cancelled_count
 FROM sh LEFT JOIN pos_orders o ON o.created_by = sh.admin_id AND o.created_at >= sh.opened_at AND o.created_at < sh.closed_at WHERE sh.now GROUP BY 1""",
    fz="SELECT sh.*, CASE WHEN now THEN CAST(sh.opening_cash + sm.cash AS DECIMAL(24,2)) END AS expected_cash, CASE WHEN now THEN '{' || "
    + " || ',' || ".join(f"'\"{c}\":' || CAST(sm.{c} AS VARCHAR)" for c in H.TOTALS)
    + " || '}' END AS totals FROM sh LEFT JOIN sm ON sm.id = sh.id",
    fd=f"SELECT * EXCLUDE (now), CASE WHEN now THEN CAST(counted_cash - expected_cash AS {MONEY}) END AS difference FROM fz",
)


def turns(t):
    return H.decide_turns(shift_requests(t), t.admins, stored_shifts(t))


@query("shift_requests", "SELECT id, admin_id, kind, target, shift_id, error FROM dc", **SHIFTS)
def shift_requests_decided(t):
    """Each request: the shift it opens or closes, or why it is refused."""
    return turns(t).select("id", "admin_id", "kind", "target", "shift_id", "error")


@query("shift_requests_shifts", "SELECT * FROM fd", **SHIFTS)
def shift_requests_shifts(t):
    """All shifts afterwards; those closed by a request with their frozen totals."""
    return H.shifts_after(turns(t), stored_shifts(t), t.orders)


@query(
    "shift_requests_audit",
    """SELECT d.id, 'shift.' || d.kind AS action, CAST(d.shift_id AS VARCHAR) AS entity_id, '{"username":' || coalesce('"' || a.username || '"', 'null') || ',"opening_cash":' || CAST(f.opening_cash AS VARCHAR) || CASE WHEN d.kind = 'open' THEN '}'
 ELSE ',"expected_cash":' || CAST(f.expected_cash AS VARCHAR) || ',"counted_cash":' || CAST(f.counted_cash AS VARCHAR) || ',"difference":' || CAST(f.difference AS VARCHAR) || '}' END AS details
 FROM dc d JOIN fd f ON f.id = d.shift_id LEFT JOIN pos_admins a ON a.id = f.admin_id WHERE d.error IS NULL""",
    **SHIFTS,
)
def shift_requests_audit(t):
    done = turns(t)
    return H.turn_audit(done, H.shifts_after(done, stored_shifts(t), t.orders), t.admins)


# ---- deletes --------------------------------------------------------------


def asked_bills(t):
    """Bills asked to be deleted: one in 97, and numbers that are no bill's."""
    k = F.col("o_orderkey")
    return t.raw("orders").filter(k % 97 == 0).select(F.when(k % 5 == 0, -k - 1).otherwise(k).alias("id"))


ASKED = dict(
    rq="SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS id FROM orders WHERE o_orderkey % 97 = 0",
    go=f"SELECT rq.id, CASE WHEN o.id IS NULL THEN '{messages.NO_ORDER}' END AS error FROM rq LEFT JOIN pos_orders o ON o.id = rq.id",
)


@query(
    "order_delete",
    """SELECT id, error, CAST(NULL AS VARCHAR) AS details FROM go WHERE error IS NOT NULL UNION ALL SELECT o.id, NULL, '{"id":' || CAST(o.id AS VARCHAR) || ',"phone":' || coalesce('"' || phone || '"', 'null') || ',"customer_name":' || coalesce('"' || customer_name || '"', 'null')
 || ',"total":' || CAST(total AS VARCHAR) || ',"payment_status":"' || payment_status || '","items":[' || coalesce((SELECT string_agg('{"name":"' || item_name || '","qty":' || CAST(qty AS VARCHAR) || ',"price":' || CAST(price AS VARCHAR) || '}', ',' ORDER BY line_no) FROM pos_order_items i WHERE i.order_id = o.id), '') || ']}'
 FROM pos_orders o JOIN go ON go.id = o.id AND go.error IS NULL""",
    **ASKED,
)
def order_delete(t):
    """Bills deleted, each with the document its audit row keeps, and refused requests."""
    asked = M.delete_requests(asked_bills(t), t.orders, messages.NO_ORDER)
    gone = asked.filter("error is null").select("id")
    kept = M.order_snapshots(gone, t.orders, t.numbered_items(gone)).select(F.col("entity_id").cast("bigint").alias("id"), "details")
    return asked.join(kept, "id", "left")


@query(
    "order_delete_moves",
    "SELECT nd.order_id, nd.ingredient_id, 'sale_reversal' AS kind, nd.need AS qty FROM nd JOIN go ON go.id = nd.order_id AND go.error IS NULL JOIN pos_orders o ON o.id = nd.order_id WHERE o.payment_status <> 'cancelled'",
    **NEED,
    **ASKED,
)
def order_delete_moves(t):
    """What deleted bills give back to the stock."""
    gone = M.delete_requests(asked_bills(t), t.orders, messages.NO_ORDER).filter("error is null")
    return S.deleted_order_moves(t.orders.join(gone.select("id"), "id", "left_semi"), needs(t))


@query(
    "ingredient_delete",
    """SELECT 'audit' AS part, g.id AS key, '{"name":"' || name || '","unit":"' || unit || '","used_in":' || CAST((SELECT count(*) FROM pos_menu_item_ingredients r WHERE r.ingredient_id = g.id) AS VARCHAR) || '}' AS value FROM pos_ingredients g WHERE id % 7 = 3
 UNION ALL SELECT 'recipe', menu_item_id, CAST(count(*) AS VARCHAR) FROM pos_menu_item_ingredients WHERE ingredient_id % 7 <> 3 GROUP BY 2
 UNION ALL SELECT 'movement', ingredient_id, CAST(count(*) AS VARCHAR) FROM pos_stock_events WHERE ingredient_id NOT IN (SELECT id FROM pos_ingredients WHERE id % 7 = 3) GROUP BY 2""",
)
def ingredient_delete(t):
    """Ingredients removed: their recipe lines and movements go with them, audit rows say how many recipes used them."""
    gone = t.ingredients.filter("id % 7 = 3").select("id")
    left = lambda df, part, key: M.without(df, gone, "ingredient_id").groupBy(F.col(key).alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit(part).alias("part"), "key", "value")
    kept = M.ingredient_snapshots(gone, t.ingredients, t.recipes)
    return M.union_all([
        kept.select(F.lit("audit").alias("part"), F.col("entity_id").cast("bigint").alias("key"), F.col("details").alias("value")),
        left(t.recipes, "recipe", "menu_item_id"),
        left(t.stock_events, "movement", "ingredient_id"),
    ])


@query(
    "coupon_delete",
    """SELECT 'audit' AS part, id AS key, code AS value FROM pos_coupons WHERE id % 4 = 1 UNION ALL SELECT 'bills', CASE WHEN coupon_id NOT IN (SELECT id FROM pos_coupons WHERE id % 4 = 1) THEN coupon_id END, CAST(count(*) AS VARCHAR) FROM pos_orders WHERE coupon_id IS NOT NULL GROUP BY 2""",
)
def coupon_delete(t):
    """Coupons removed: bills lose the reference and keep what they were granted; the audit row names the code."""
    gone = t.coupons.filter("id % 4 = 1").select("id")
    documents = M.delete_snapshots(t.coupons.withColumn("name", F.col("code")), gone, [*(c for c in M.COUPON_COLUMNS if c in t.coupons.columns), "name"], "coupon")
    bills = M.orphaned(t.orders.filter("coupon_id is not null").select("id", "coupon_id"), gone, "coupon_id").groupBy(F.col("coupon_id").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return documents.select(F.lit("audit").alias("part"), F.col("entity_id").cast("bigint").alias("key"), F.get_json_object("details", "$.name").alias("value")).unionByName(
        bills.select(F.lit("bills").alias("part"), "key", "value")
    )


def number_moves(t):
    """Customers asking for another number: a fresh one, a neighbour's, one that two ask for, or none at all."""
    k = F.col("phone").cast("bigint")
    wanted = F.when(k % 15 == 0, F.lit("98-76")).when(k % 6 == 0, (k + 1).cast("string")).otherwise((k - k % 9 - 1_000_000_000).cast("string"))
    return t.customers.filter(k % 3 == 0).select("phone", wanted.alias("new_phone"))


MOVES = dict(
    w="""SELECT phone, CASE WHEN CAST(phone AS BIGINT) % 15 = 0 THEN '98-76' WHEN CAST(phone AS BIGINT) % 6 = 0 THEN CAST(CAST(phone AS BIGINT) + 1 AS VARCHAR) ELSE CAST(CAST(phone AS BIGINT) - CAST(phone AS BIGINT) % 9 - 1000000000 AS VARCHAR) END AS new_phone FROM pos_customers WHERE CAST(phone AS BIGINT) % 3 = 0""",
    mv="SELECT min(phone) AS phone, new_phone FROM w WHERE new_phone <> '98-76' AND new_phone NOT IN (SELECT phone FROM pos_customers) GROUP BY 2",
)


@query(
    "phone_rekey",
    """SELECT 'customer' AS part, coalesce(new_phone, c.phone) AS phone, count(*) AS rows FROM pos_customers c LEFT JOIN mv ON mv.phone = c.phone GROUP BY 2
 UNION ALL SELECT 'bills', coalesce(new_phone, o.phone), count(*) FROM pos_orders o LEFT JOIN mv ON mv.phone = o.phone GROUP BY 2""",
    **MOVES,
)
def phone_rekey(t):
    """Customers under their new numbers, followed by their bills."""
    people, made = M.rekey_customers(t.customers, number_moves(t))
    count = lambda df, part: df.groupBy("phone").agg(F.count("*").alias("rows")).select(F.lit(part).alias("part"), "phone", "rows")
    return count(people, "customer").unionByName(count(M.rekey_phones(t.orders.select("id", "phone"), made), "bills"))


# ---- audit texts ----------------------------------------------------------


def documents(t):
    """Every event as an audit row of one of the kinds with a text of their own."""
    e = F.col("event_id")
    k = (e % 100).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = lambda q: text('{"name":"Dish ', k, f'","qty":{q},"unit":"g"}}')
    kinds = [
        ("order.delete", text('{"customer_name":', F.when(e % 3 == 0, "null").otherwise('"Ann"'), ',"phone":"9', k, '","total":12.50,"payment_status":"paid","items":[', line("2"), ",", line("1"), "]}")),
        ("menu.recipe", text('{"name":"Dish ', k, '","from":[],"to":[', line("2.500"), ",", line("10.000"), "]}")),
        ("menu.delete", text('{"name":"Dish ', k, '","category":"Soup","price":7.00', F.when(e % 2 == 0, text(',"recipe":[', line("0.250"), "]")).otherwise(F.lit("")), "}")),
        ("stock.count", text('{"name":"Rice","unit":"g","before":10.500,"after":', k, F.when(e % 3 == 0, ',"note":"late"').otherwise(',"note":null'), "}")),
        ("shift.close", text('{"username":"staff1","expected_cash":100.00,"counted_cash":90.00,"difference":', F.when(e % 3 == 0, "0.00").when(e % 3 == 1, "-10.00").otherwise("2.50"), "}")),
        ("staff.password", text('{"username":"staff1","sessions_signed_out":', (e % 3).cast("string"), "}")),
        ("staff.update", text('{"username":"staff1","changes":{"password":["",""],"role":["admin","super"]},"sessions_signed_out":', (e % 3).cast("string"), "}")),
    ]
    action, details = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, body) in enumerate(kinds):
        action, details = F.when(e % 7 == i, name).otherwise(action), F.when(e % 7 == i, body).otherwise(details)
    return t.raw("events").select(e.alias("id"), action.alias("action"), F.col("user_id").cast("string").alias("entity_id"), details.alias("details"))


@query(
    "audit_texts",
    """SELECT id, CASE id % 7 WHEN 0 THEN 'order.delete' WHEN 1 THEN 'menu.recipe' WHEN 2 THEN 'menu.delete' WHEN 3 THEN 'stock.count' WHEN 4 THEN 'shift.close' WHEN 5 THEN 'staff.password' ELSE 'staff.update' END AS action,
 CASE id % 7 WHEN 0 THEN 'Order #' || u WHEN 1 THEN 'Dish ' || k WHEN 2 THEN 'Dish ' || k WHEN 3 THEN 'Rice' WHEN 4 THEN 'Shift #' || u || ' · staff1' ELSE 'staff1' END AS target,
 CASE id % 7 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN 'Customer' ELSE 'Ann' END || ' · 9' || k || ' · ₹12.50 · paid; 2× Dish ' || k || ', 1× Dish ' || k WHEN 1 THEN 'Before: none; After: 2.5 g Dish ' || k || ', 10 g Dish ' || k
 WHEN 2 THEN 'Soup · ₹7.00' || CASE WHEN id % 2 = 0 THEN '; Recipe: 0.25 g Dish ' || k ELSE '' END WHEN 3 THEN '10.5 → ' || k || ' g' || CASE WHEN id % 3 = 0 THEN '; late' ELSE '' END
 WHEN 4 THEN 'Expected ₹100.00 · counted ₹90.00 · ' || CASE id % 3 WHEN 0 THEN 'Exact match' WHEN 1 THEN 'Short by ₹10.00' ELSE 'Over by ₹2.50' END
 WHEN 5 THEN CASE WHEN id % 3 > 0 THEN CAST(id % 3 AS VARCHAR) || ' session(s) signed out' ELSE '' END ELSE 'password reset; role: admin → super' || CASE WHEN id % 3 > 0 THEN '; ' || CAST(id % 3 AS VARCHAR) || ' session(s) signed out' ELSE '' END END AS summary
 FROM (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS u, CAST(event_id % 100 AS VARCHAR) AS k FROM events)""",
)
def audit_texts(t):
    return D.render(documents(t), SHOP.currency).select("id", "action", "target", "summary")


# ---- refusals of coupons --------------------------------------------------

QUOTES = dict(**CQ.BATCH, **CQ.PAST, **CQ.quoted(CQ.DAY))


@query(
    "coupon_refusals",
    """SELECT q.id, q.code, q.reason, CASE q.reason WHEN 'no code' THEN 'Enter a coupon code.' WHEN 'unknown' THEN 'Coupon ' || q.code || ' does not exist.' WHEN 'off' THEN 'Coupon ' || q.code || ' is switched off.'
 WHEN 'not started' THEN 'Coupon ' || q.code || ' can be used from ' || strftime(c.valid_from, '%d %b %Y') || '.' WHEN 'expired' THEN 'Coupon ' || q.code || ' expired on ' || strftime(c.valid_to, '%d %b %Y') || '.'
 WHEN 'below minimum' THEN 'Coupon ' || q.code || ' needs a bill of at least ₹' || CAST(c.min_bill AS VARCHAR) || '.' WHEN 'nothing covered' THEN 'Coupon ' || q.code || ' does not cover any item in this bill.'
 WHEN 'used up' THEN 'Coupon ' || q.code || ' has been used up.' WHEN 'needs phone' THEN 'Coupon ' || q.code || ' needs the customer''s phone number. Go back and enter it.'
 WHEN 'customer limit' THEN 'This customer has already used coupon ' || q.code || CASE WHEN c.per_customer_limit = 1 THEN '.' ELSE ' ' || CAST(c.per_customer_limit AS VARCHAR) || ' times.' END
 WHEN 'too few items' THEN 'Coupon ' || q.code || ' needs ' || CAST(c.buy_qty + c.get_qty AS VARCHAR) || ' eligible items in the bill (buy ' || CAST(c.buy_qty AS VARCHAR) || ', get ' || CAST(c.get_qty AS VARCHAR) || ' free).' END AS message
 FROM q LEFT JOIN pos_coupons c ON c.id = q.coupon_id""",
    **QUOTES,
)
def coupon_refusals(t):
    """Every bill with a coupon against past uses, and the sentence a refused one gets."""
    return C.refusal_texts(C.quote(*CQ.batch(t), past=t.orders), t.coupons, SHOP.currency).select("id", "code", "reason", "message")


# ---- audit rows of edits --------------------------------------------------


@query(
    "ingredient_edit_audit",
    """SELECT CAST(n.id AS VARCHAR) AS entity_id, CASE WHEN o.id IS NULL THEN 'ingredient.create' ELSE 'ingredient.update' END AS action, CASE WHEN o.id IS NULL THEN '{"name":"' || n.name || '","unit":"' || n.unit || '"}'
 ELSE '{"name":"' || n.name || '","changes":{' || concat_ws(',', CASE WHEN o.name <> n.name THEN '"name":["' || o.name || '","' || n.name || '"]' END, CASE WHEN o.unit <> n.unit THEN '"unit":["' || o.unit || '","' || n.unit || '"]' END) || '}}' END AS details
 FROM ed n LEFT JOIN pos_ingredients o ON o.id = n.id WHERE n.error IS NULL AND (o.id IS NULL OR o.name <> n.name OR o.unit <> n.unit)""",
    **JQ.INGREDIENT_STAGE,
)
def ingredient_edit_audit(t):
    applied = M.apply_edits(t.ingredients, M.ingredient_edits(JQ.ingredient_stage(t), t.ingredients), M.INGREDIENT_COLUMNS)
    return M.edit_audit(applied, "ingredient", M.INGREDIENT_COLUMNS, "name")


def _pair(column: str, quote: str = "'\"'") -> str:
    shown = lambda side: f"coalesce({quote} || CAST({side}.{column} AS VARCHAR) || {quote}, 'null')"
    return f"""CASE WHEN o.{column} IS DISTINCT FROM n.{column} THEN '"{column}":[' || {shown('o')} || ',' || {shown('n')} || ']' END"""


STAFF_CHANGES = ", ".join(_pair(c, "''" if c in ("auto_approve", "is_active") else "'\"'") for c in sorted(M.STAFF_COLUMNS))
STAFF_SNAPSHOT = " || ',' || ".join(
    f"""'"{c}":' || coalesce({"CAST(n." + c + " AS VARCHAR)" if c in ("auto_approve", "is_active") else "'" + chr(34) + "' || n." + c + " || '" + chr(34) + "'"}, 'null')""" for c in M.STAFF_COLUMNS
)


@query(
    "staff_edit_audit",
    f"""SELECT CAST(n.id AS VARCHAR) AS entity_id, CASE WHEN o.id IS NULL THEN 'staff.create' ELSE 'staff.update' END AS action, CASE WHEN o.id IS NULL THEN '{{' || {STAFF_SNAPSHOT} || '}}'
 ELSE '{{"username":"' || n.username || '","changes":{{' || concat_ws(',', {STAFF_CHANGES}) || '}},"sessions_signed_out":' || CAST(CASE WHEN o.role <> n.role OR (o.is_active AND NOT n.is_active) THEN (SELECT count(*) FROM pos_sessions s WHERE s.admin_id = o.id) ELSE 0 END AS VARCHAR) || '}}' END AS details
 FROM ed n LEFT JOIN pos_admins o ON o.id = n.id WHERE n.error IS NULL AND (o.id IS NULL OR concat_ws(',', {STAFF_CHANGES}) <> '')""",
    **JQ.STAFF_STAGE,
)
def staff_edit_audit(t):
    """Accounts created and changed, with the sessions that a change of role or a deactivation ended."""
    edits = M.staff_edits(JQ.staff_stage(t), t.admins)
    ended = M.sessions_ended(t.sessions, M.sessions_after_staff_edits(t.sessions, t.admins, edits))
    return M.edit_audit(M.apply_edits(t.admins, edits, M.STAFF_COLUMNS), "staff", M.STAFF_COLUMNS, "username", "username", ended)


@query(
    "recipe_replace_audit",
    """SELECT CAST(menu_item_id AS VARCHAR) AS entity_id, 'menu.recipe' AS action, '{"name":"' || name || '","from":' || b || ',"to":' || a || '}' AS details FROM
 (SELECT gi.menu_item_id, m.name, coalesce(o.j, '[]') AS b, coalesce(n.j, '[]') AS a FROM gi JOIN pos_menu_items m ON m.id = gi.menu_item_id LEFT JOIN oj o ON o.menu_item_id = gi.menu_item_id LEFT JOIN nj n ON n.menu_item_id = gi.menu_item_id) WHERE a <> b""",
    rp=SQ.RECIPE_PAYLOADS,
    rl=SQ.RECIPE_LINES,
    rg=SQ.RECIPE_GOOD,
    gi="SELECT DISTINCT menu_item_id FROM rg",
    nr="SELECT rg.menu_item_id, rg.ingredient_id, CAST(sum(rg.qty) AS DECIMAL(12,3)) AS qty FROM rg GROUP BY 1, 2",
    **{
        name: f"""SELECT menu_item_id, '[' || string_agg('{{"ingredient_id":' || CAST(ingredient_id AS VARCHAR) || ',"name":"' || i.name || '","unit":"' || i.unit || '","qty":' || CAST(r.qty AS VARCHAR) || '}}', ',' ORDER BY lower(i.name), ingredient_id) || ']' AS j
 FROM {table} r JOIN pos_ingredients i ON i.id = r.ingredient_id GROUP BY 1"""
        for name, table in (("oj", "pos_menu_item_ingredients"), ("nj", "nr"))
    },
)
def recipe_replace_audit(t):
    return M.recipe_audit(M.replace_recipes(t.recipes, SQ.recipe_payloads(t), t.menu, t.ingredients)[1])


# ---- columns added later --------------------------------------------------


@query(
    "backfill_sessions",
    """SELECT id, admin_id, approved_at AS raw_approved_at, CASE WHEN created_at < TIMESTAMP '2024-01-15' THEN coalesce(approved_at, created_at) ELSE approved_at END AS approved_at FROM pos_sessions""",
)
def backfill_sessions(t):
    """Sessions from before sign-ins needed approval count as approved when they began."""
    rows = M.backfill_sessions(t.sessions.withColumn("raw_approved_at", F.col("approved_at")), "2024-01-15")
    return rows.select("id", "admin_id", "raw_approved_at", "approved_at")


@query("backfill_admins", "SELECT id, username, true AS auto_approve FROM pos_admins")
def backfill_admins(t):
    """Accounts from before sign-ins needed approval go on without it."""
    return M.backfill_admins(t.admins).select("id", "username", "auto_approve")


# ---- first board ----------------------------------------------------------


@query(
    "board_summary",
    """SELECT coalesce((SELECT 'Order #' || CAST(max_by(id, pos) AS VARCHAR) || ' is being prepared' FROM la WHERE lane = 'preparing' HAVING count(*) > 0), (SELECT CAST(count(*) AS VARCHAR) || ' waiting' FROM la WHERE lane = 'queued' HAVING count(*) > 0),
 (SELECT 'Order #' || CAST(min_by(id, pos) AS VARCHAR) || ' is ready' FROM la WHERE lane = 'ready' HAVING count(*) > 0), (SELECT CAST(count(*) AS VARCHAR) || ' served up today' FROM pos_orders WHERE payment_status <> 'cancelled' AND created_at >= TIMESTAMP '1998-06-30 18:30:00' HAVING count(*) > 0), 'No orders yet today') AS text""",
    a=SNAP.format(ts="TIMESTAMP '1998-07-01 12:00:00'"),
    la=lanes("a"),
)
def board_summary(t):
    """The line over a board that has no earlier one to compare with."""
    return K.board_summary(K.lane_top_n(snapshots(t)[0]), K.today_counters(t.orders, AS_OF))


# ---- rules of the tables --------------------------------------------------

#: Per table the conditions every row meets; the texts are read by both engines.
ROW_RULES = {
    ("admins", "pos_admins"): ["username is not null", "role in ('super', 'admin')", "is_active is not null", "auto_approve is not null", "(login_from is null) = (login_to is null)"],
    ("sessions", "pos_sessions"): ["admin_id is not null", "created_at is not null", "expires_at is not null", "expires_at > created_at"],
    ("menu", "pos_menu_items"): ["name is not null", "category is not null", "price is not null", "price >= 0", "is_active is not null"],
    ("customers", "pos_customers"): ["phone is not null", "length(phone) = 10"],
    ("orders", "pos_orders"): [
        "total is not null", "total >= 0", "payment_status is not null", "payment_status in ('paid', 'pending', 'cancelled')", "payment_method in ('cash', 'upi', 'card')", "payment_method is not null",
        "kitchen_status in ('new', 'preparing', 'ready', 'served')", "created_at is not null", "discount >= 0", "discount <= total", "kitchen_status = 'new' or kitchen_updated_at is not null",
    ],
    ("order_items", "pos_order_items"): ["order_id is not null", "item_name is not null", "price is not null", "qty is not null", "qty > 0"],
    ("coupons", "pos_coupons"): [
        "code is not null", "kind in ('percent', 'flat', 'bogo')", "value >= 0", "max_discount > 0", "min_bill >= 0", "buy_qty > 0", "get_qty > 0", "applies_to in ('all', 'items')", "usage_limit > 0", "per_customer_limit > 0",
        "valid_from is null or valid_to is null or valid_to >= valid_from", "kind <> 'bogo' or (buy_qty is not null and get_qty is not null)",
    ],
    ("logins", "pos_login_attempts"): ["username is not null", "succeeded is not null", "created_at is not null"],
    ("audit", "pos_audit_log"): ["action is not null", "details is not null", "created_at is not null"],
    ("shifts", "pos_shifts"): ["opened_at is not null", "opening_cash >= 0", "closed_at >= opened_at", "(closed_at is null) = (counted_cash is null)"],
    ("ingredients", "pos_ingredients"): ["name is not null", "unit in ('g', 'kg', 'ml', 'l', 'pcs')", "track_stock is not null", "stock is not null", "low_stock_at >= 0"],
    ("recipes", "pos_menu_item_ingredients"): ["qty is not null", "qty > 0"],
    ("stock_events", "pos_stock_events"): ["qty is not null", "kind in ('purchase', 'waste', 'count', 'sale', 'sale_reversal')"],
}
#: (child table, view, column, parent table, parent view, parent column)
REFERENCES = [
    ("sessions", "pos_sessions", "admin_id", "admins", "pos_admins", "id"), ("sessions", "pos_sessions", "approved_by", "admins", "pos_admins", "id"),
    ("orders", "pos_orders", "created_by", "admins", "pos_admins", "id"), ("orders", "pos_orders", "coupon_id", "coupons", "pos_coupons", "id"), ("orders", "pos_orders", "phone", "customers", "pos_customers", "phone"),
    ("order_items", "pos_order_items", "order_id", "orders", "pos_orders", "id"), ("order_items", "pos_order_items", "menu_item_id", "menu", "pos_menu_items", "id"),
    ("shifts", "pos_shifts", "admin_id", "admins", "pos_admins", "id"), ("shifts", "pos_shifts", "closed_by", "admins", "pos_admins", "id"),
    ("recipes", "pos_menu_item_ingredients", "menu_item_id", "menu", "pos_menu_items", "id"), ("recipes", "pos_menu_item_ingredients", "ingredient_id", "ingredients", "pos_ingredients", "id"),
    ("stock_events", "pos_stock_events", "ingredient_id", "ingredients", "pos_ingredients", "id"), ("stock_events", "pos_stock_events", "order_id", "orders", "pos_orders", "id"),
]
#: (table, view, key, rows concerned)
UNIQUE = [
    ("admins", "pos_admins", "lower(username)", "true"), ("sessions", "pos_sessions", "id", "true"), ("menu", "pos_menu_items", "id", "true"), ("customers", "pos_customers", "phone", "true"), ("orders", "pos_orders", "id", "true"),
    ("coupons", "pos_coupons", "upper(code)", "true"), ("ingredients", "pos_ingredients", "lower(name)", "true"), ("shifts", "pos_shifts", "admin_id", "closed_at is null"),
    ("recipes", "pos_menu_item_ingredients", "concat(menu_item_id, ' ', ingredient_id)", "true"),
]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "constraint_rules",
    " UNION ALL ".join(
        [f"SELECT {_literal(f'{name}: {rule}')} AS rule, count(*) FILTER (NOT ({rule})) AS violations FROM {view}" for (name, view), rules in ROW_RULES.items() for rule in rules]
        + [f"SELECT {_literal(f'{a}.{c} in {b}')}, count(*) FROM {va} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {vb} y WHERE y.{k} = x.{c})" for a, va, c, b, vb, k in REFERENCES]
        + [f"SELECT {_literal(f'{a}: one {k} where {w}')}, count(*) - count(DISTINCT {k}) FROM {v} WHERE {w}" for a, v, k, w in UNIQUE]
    ),
)
def constraint_rules(t):
    """Violations of every condition, reference and key of the tables, one row a rule."""
    frames = [M.rule_counts(getattr(t, name), {f"{name}: {rule}": F.expr(rule) for rule in rules}) for (name, _), rules in ROW_RULES.items()]
    frames += [M.missing_parents(getattr(t, a), c, getattr(t, b).select(F.col(k).alias("id")), f"{a}.{c} in {b}") for a, _, c, b, _, k in REFERENCES]
    frames += [M.repeated_keys(getattr(t, a).filter(w), F.expr(k), f"{a}: one {k} where {w}") for a, _, k, w in UNIQUE]
    return M.union_all(frames)
