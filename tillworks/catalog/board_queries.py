"""Joins, boards, pages, stock and shifts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tillworks.catalog.params import ALL_DAYS_SQL, AS_OF, AS_OF_SQL, ONE_YEAR, SHOP
from tillworks.catalog.registry import query
from tillworks.functions import labels
from tillworks.functions.timeutil import DayRange
from tillworks.operators import kitchen as K
from tillworks.operators import pages as P
from tillworks.operators import shifts as H
from tillworks.operators import stock as S
from tillworks.plans import boards as B
from tillworks.plans import reports as R
from tillworks.plans.bills import recipe_explosion
from tillworks.sources import payloads

M, Q14, Q24 = "DECIMAL(24,2)", "DECIMAL(14,3)", "DECIMAL(24,3)"
ITEMS = "string_agg(CAST(qty AS VARCHAR) || '× ' || item_name, ', ' ORDER BY line_no)"
NESTED = f"(SELECT {ITEMS} FROM pos_order_items i WHERE i.order_id = o.id)"
ONE_YEAR_SHIFTS = "opened_at >= TIMESTAMP '1997-12-31 18:30:00' AND opened_at < TIMESTAMP '1998-12-31 18:30:00'"


# ---- joins ----------------------------------------------------------------


@query(
    "join_items_orders",
    "SELECT i.menu_item_id, CAST(sum(i.qty) AS BIGINT) AS qty FROM pos_order_items i JOIN pos_orders o ON o.id = i.order_id WHERE o.payment_status = 'paid' AND " + ALL_DAYS_SQL.replace("created_at", "o.created_at") + " GROUP BY 1",
)
def join_items_orders(t):
    from tillworks.catalog.params import ALL_DAYS

    return R.sold_quantities(t.orders_between(ALL_DAYS).filter("payment_status = 'paid'"), t.order_lines)


@query("join_lines_menu", "SELECT l.bill_id, l.line_no, l.menu_item_id, m.name, m.price, l.qty FROM pos_bill_lines l JOIN pos_menu_items m ON m.id = l.menu_item_id AND m.is_active WHERE l.qty > 0")
def join_lines_menu(t):
    from tillworks.plans.bills import priced_lines

    return priced_lines(payloads.explode_bill_items(t.bills), t.menu).select("bill_id", "line_no", "menu_item_id", "name", "price", "qty")


@query(
    "recipe_explosion",
    f"""SELECT i.order_id, i.menu_item_id, g.id AS ingredient_id, g.name AS ingredient_name, g.unit, CAST(r.qty * i.qty AS {Q14}) AS qty
 FROM pos_order_items i JOIN pos_menu_item_ingredients r ON r.menu_item_id = i.menu_item_id JOIN pos_ingredients g ON g.id = r.ingredient_id""",
)
def explosion(t):
    return recipe_explosion(t.order_lines, t.recipes, t.ingredients)


@query("join_tracked_ingredients", "SELECT r.menu_item_id, g.id AS ingredient_id, g.stock, r.qty AS need FROM pos_menu_item_ingredients r JOIN pos_ingredients g ON g.id = r.ingredient_id WHERE g.track_stock")
def join_tracked(t):
    part = t.ingredients.filter("track_stock").select(F.col("id").alias("ingredient_id"), "stock")
    return t.recipes.join(part, "ingredient_id").select("menu_item_id", "ingredient_id", "stock", F.col("qty").alias("need"))


@query("join_author", "SELECT o.id, coalesce(a.username, '—') AS author FROM pos_orders o LEFT JOIN pos_admins a ON a.id = o.created_by")
def join_author(t):
    return P.with_author(t.orders.select("id", "created_by"), t.admins, missing="—").select("id", "author")


@query(
    "shift_order_range_join",
    f"""SELECT s.id AS shift_id, o.id, o.total, o.payment_status FROM pos_shifts s JOIN pos_orders o ON o.created_by = s.admin_id AND o.created_at >= s.opened_at AND o.created_at < coalesce(s.closed_at, {AS_OF_SQL})""",
)
def shift_range_join(t):
    return H.shift_orders(t.shifts, t.orders, AS_OF).select("shift_id", "id", "total", "payment_status")


@query("semi_join_touched", "SELECT id, name FROM pos_ingredients WHERE id IN (SELECT ingredient_id FROM pos_stock_events WHERE order_id IS NOT NULL)")
def semi_touched(t):
    return S.touched_ingredients(t.ingredients, t.stock_events).select("id", "name")


@query("nested_items", "SELECT o.id, i.line_no, i.item_name, i.price, i.qty FROM pos_orders o LEFT JOIN pos_order_items i ON i.order_id = o.id")
def nested_items(t):
    lines = t.numbered_items().select(F.col("order_id").alias("id"), "line_no", "item_name", "price", "qty")
    return t.orders.select("id").join(lines, "id", "left")


@query("correlated_counts", "SELECT id, (SELECT count(*) FROM pos_menu_item_ingredients r WHERE r.ingredient_id = i.id) AS used_count FROM pos_ingredients i")
def correlated_counts(t):
    return P.used_counts(t.ingredients, t.recipes).select("id", "used_count")


STOCK = dict(
    mx="SELECT r.menu_item_id, r.qty AS need, g.* FROM pos_menu_item_ingredients r JOIN pos_ingredients g ON g.id = r.ingredient_id WHERE g.track_stock",
    ms="""SELECT menu_item_id, CAST(least(greatest(min(CAST(stock * 1000 AS BIGINT) // CAST(need * 1000 AS BIGINT)), 0), 1000000) AS INTEGER) AS can_make,
 CASE WHEN bool_or(stock < need) THEN 'out' WHEN bool_or(low_stock_at IS NOT NULL AND stock <= low_stock_at) THEN 'low' ELSE 'ok' END AS status,
 coalesce(string_agg(name, ',' ORDER BY CAST(stock AS DOUBLE) / CAST(need AS DOUBLE), name) FILTER (stock < need OR (low_stock_at IS NOT NULL AND stock <= low_stock_at)), '') AS short FROM mx GROUP BY 1""",
)


@query("menu_stock", "SELECT * FROM ms", **STOCK)
def menu_stock(t):
    return S.menu_stock(t.recipes, t.ingredients).withColumn("short", F.array_join(F.transform("short", lambda s: s["name"]), ","))


@query("menu_status_join", "SELECT m.id, m.name, coalesce(ms.status, 'ok') AS status FROM pos_menu_items m LEFT JOIN ms ON ms.menu_item_id = m.id WHERE m.is_active", **STOCK)
def menu_status_join(t):
    return S.sellable_menu(t.menu, S.menu_stock(t.recipes, t.ingredients), hide_out_of_stock=False).select("id", "name", "status")


@query(
    "hide_out_of_stock_menu",
    "SELECT m.id, m.name, coalesce(ms.status, 'ok') AS status, ms.can_make AS max_qty, false AS warn FROM pos_menu_items m LEFT JOIN ms ON ms.menu_item_id = m.id WHERE m.is_active AND coalesce(ms.status, 'ok') <> 'out'",
    **STOCK,
)
def hide_out_of_stock(t):
    return S.sellable_menu(t.menu, S.menu_stock(t.recipes, t.ingredients), hide_out_of_stock=SHOP.hide_out_of_stock)


# ---- stock ----------------------------------------------------------------

NEED = dict(
    nd=f"""SELECT i.order_id, g.id AS ingredient_id, CAST(sum(r.qty * i.qty) AS {Q14}) AS need FROM pos_order_items i JOIN pos_menu_item_ingredients r ON r.menu_item_id = i.menu_item_id
 JOIN pos_ingredients g ON g.id = r.ingredient_id WHERE g.track_stock GROUP BY 1, 2"""
)


def needs(t):
    return S.bill_needs(recipe_explosion(t.order_lines, t.recipes, t.ingredients), t.ingredients)


query("bill_ingredient_need", "SELECT * FROM nd", **NEED)(needs)


@query(
    "stock_deduct",
    f"""SELECT order_id, ingredient_id, CAST(-need AS {Q14}) AS qty, balance_after, balance_after < 0 AS warn, created_at FROM (SELECT nd.*, o.created_at,
 CAST(g.stock - sum(nd.need) OVER (PARTITION BY nd.ingredient_id ORDER BY o.created_at, nd.order_id ROWS UNBOUNDED PRECEDING) AS {Q24}) AS balance_after
 FROM nd JOIN pos_orders o ON o.id = nd.order_id JOIN pos_ingredients g ON g.id = nd.ingredient_id)""",
    **NEED,
)
def stock_deduct(t):
    return S.deduct_sales(needs(t), t.orders, t.ingredients)


#: Bill by bill in time order; ``st`` is what is left of every tracked ingredient.
BLOCK = dict(
    g="SELECT id, stock, row_number() OVER (ORDER BY id) AS i FROM pos_ingredients WHERE track_stock",
    bl=f"SELECT nd.order_id, o.created_at, list({{'i': g.i, 'q': CAST(nd.need AS {Q24})}}) AS c FROM nd JOIN g ON g.id = nd.ingredient_id JOIN pos_orders o ON o.id = nd.order_id GROUP BY 1, 2",
    t="SELECT row_number() OVER (ORDER BY created_at, order_id) AS n, order_id, c FROM bl",
    rc=f"""SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS BOOLEAN) AS accepted, (SELECT list(CAST(stock AS {Q24}) ORDER BY i) FROM g) AS st
 UNION ALL SELECT n, order_id, ok, CASE WHEN ok THEN list_transform(st, lambda s, i: s - coalesce(list_filter(c, lambda x: x.i = i)[1].q, 0)) ELSE st END FROM
 (SELECT t.n, t.order_id, t.c, rc.st, len(list_filter(t.c, lambda x: rc.st[x.i] < x.q)) = 0 AS ok FROM rc JOIN t ON t.n = rc.n + 1)""",
)


@query("stock_deduct_block", "SELECT order_id, accepted FROM rc WHERE n > 0", **NEED, **BLOCK)
def stock_deduct_block(t):
    return S.deduct_sales_blocking(needs(t), t.orders, t.ingredients)


CHANGES = """SELECT id, order_id, old, new, created_at FROM (SELECT id, order_id, created_at, {c} AS new, lag({c}) OVER (PARTITION BY order_id ORDER BY created_at, id) AS old FROM pos_status_events {w}) WHERE old <> new"""


@query(
    "stock_restore",
    f"""SELECT c.order_id, nd.ingredient_id, CASE WHEN new = 'cancelled' THEN 'sale_reversal' ELSE 'sale' END AS kind, CAST(CASE WHEN new = 'cancelled' THEN need ELSE -need END AS {Q14}) AS qty, c.created_at
 FROM ch c JOIN nd ON nd.order_id = c.order_id WHERE new = 'cancelled' OR old = 'cancelled'
 UNION ALL SELECT nd.order_id, nd.ingredient_id, 'sale_reversal', nd.need, NULL FROM nd JOIN pos_orders o ON o.id = nd.order_id WHERE o.id % 97 = 0 AND o.payment_status <> 'cancelled'""",
    **NEED,
    ch=CHANGES.format(c="payment_status", w=""),
)
def stock_restore(t):
    """Cancelled, un-cancelled and deleted bills."""
    need = needs(t)
    moved = S.status_moves(K.status_changes(t.status_events, "payment_status"), need)
    deleted = S.deleted_order_moves(t.orders.filter("id % 97 = 0"), need).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return moved.unionByName(deleted)


LEDGER = dict(
    ok="SELECT * FROM pos_stock_events WHERE (kind = 'count' AND qty BETWEEN 0 AND 1000000000) OR (kind <> 'count' AND qty > 0 AND qty <= 1000000000)",
    sg="SELECT *, CASE WHEN kind IN ('purchase','sale_reversal') THEN qty WHEN kind IN ('waste','sale') THEN -qty ELSE 0 END AS chg, count(*) FILTER (kind = 'count') OVER (PARTITION BY ingredient_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS seg FROM ok",
    bl="""SELECT sg.id, sg.ingredient_id, sg.kind, sg.order_id, sg.created_at, coalesce(max(CASE WHEN kind = 'count' THEN qty END) OVER (PARTITION BY ingredient_id, seg), g.stock, 0)
 + sum(chg) OVER (PARTITION BY ingredient_id, seg ORDER BY sg.created_at, sg.id ROWS UNBOUNDED PRECEDING) AS bal, coalesce(g.stock, 0) AS opening FROM sg LEFT JOIN pos_ingredients g ON g.id = sg.ingredient_id""",
    lg=f"""SELECT id, ingredient_id, CASE kind WHEN 'count' THEN 'adjust' ELSE kind END AS kind, CAST(bal - lag(bal, 1, opening) OVER (PARTITION BY ingredient_id ORDER BY created_at, id) AS {Q24}) AS qty,
 CAST(bal AS {Q24}) AS balance_after, order_id, created_at FROM bl""",
)


@query("stock_ledger", "SELECT * FROM lg", **LEDGER)
def stock_ledger(t):
    return S.stock_ledger(t.stock_events, t.ingredients)


@query("stock_running_balance", "SELECT id, ingredient_id, balance_after FROM lg", **LEDGER)
def stock_running_balance(t):
    return S.stock_ledger(t.stock_events, t.ingredients).select("id", "ingredient_id", "balance_after")


@query("append_ledger", "SELECT id, ingredient_id, kind, qty, balance_after FROM lg", **LEDGER)
def append_ledger(t):
    """Ledger rows appended in two batches, the second delivered twice, and read back."""
    from tillworks.sources.sinks import append_ledger as append
    from tillworks.streaming.feeds import new_run

    path = new_run(t.spark, "ledger")
    rows = S.stock_ledger(t.stock_events, t.ingredients)
    for batch, part in ((0, "id % 2 = 0"), (1, "id % 2 = 1"), (1, "id % 2 = 1")):
        append(rows.filter(part), path, batch)
    return t.spark.read.parquet(path).select("id", "ingredient_id", "kind", "qty", "balance_after")


@query("net_order_movement", f"SELECT order_id, ingredient_id, CAST(-sum(qty) AS {Q14}) AS back FROM lg WHERE order_id IS NOT NULL GROUP BY 1, 2 HAVING sum(qty) <> 0", **LEDGER)
def net_order_movement(t):
    return S.net_movements(S.stock_ledger(t.stock_events, t.ingredients))


@query(
    "latest_movements",
    "SELECT pos, x.id, ingredient_id, kind, qty, balance_after, username FROM (SELECT lg.*, row_number() OVER (PARTITION BY ingredient_id ORDER BY created_at DESC, id DESC) AS pos FROM lg) x LEFT JOIN pos_admins a ON a.id = x.id % 25 WHERE pos <= 50",
    **LEDGER,
)
def latest_movements(t):
    rows = S.latest_movements(S.stock_ledger(t.stock_events, t.ingredients), 50).withColumn("mover", F.col("id") % 25)
    return P.with_author(rows, t.admins, "mover", "username").select("pos", "id", "ingredient_id", "kind", "qty", "balance_after", "username")


@query("low_stock", "SELECT id, name, unit, stock, low_stock_at FROM pos_ingredients WHERE track_stock AND stock <= coalesce(low_stock_at, 0)")
def low_stock(t):
    return P.low_stock(t.ingredients).select("id", "name", "unit", "stock", "low_stock_at")


# ---- shifts ---------------------------------------------------------------

SHIFT = dict(
    so=f"SELECT s.id AS shift_id, o.* EXCLUDE (id) FROM pos_shifts s JOIN pos_orders o ON o.created_by = s.admin_id AND o.created_at >= s.opened_at AND o.created_at < coalesce(s.closed_at, {AS_OF_SQL})",
    st=f"""SELECT shift_id, count(*) FILTER (payment_status = 'paid') AS orders, CAST(coalesce(sum(total) FILTER (payment_status = 'paid'), 0) AS {M}) AS sales,
 CAST(coalesce(sum(total) FILTER (payment_status = 'paid' AND payment_method = 'cash'), 0) AS {M}) AS cash, CAST(coalesce(sum(total) FILTER (payment_status = 'paid' AND payment_method = 'upi'), 0) AS {M}) AS upi,
 CAST(coalesce(sum(total) FILTER (payment_status = 'paid' AND payment_method = 'card'), 0) AS {M}) AS card, count(*) FILTER (payment_status = 'pending') AS pending_count,
 CAST(coalesce(sum(total) FILTER (payment_status = 'pending'), 0) AS {M}) AS pending_total, count(*) FILTER (payment_status = 'cancelled') AS cancelled_count,
 CAST(coalesce(sum(total) FILTER (payment_status = 'cancelled'), 0) AS {M}) AS cancelled_total FROM so GROUP BY 1""",
    rc=f"""SELECT s.id, a.username, s.opened_at, s.closed_at, s.closed_at IS NULL AS is_open, c.username AS closed_by_name, s.opening_cash, coalesce(orders, 0) AS orders,
 {', '.join(f'CAST(coalesce({c}, 0) AS {M}) AS {c}' for c in ('sales', 'cash', 'upi', 'card'))}, coalesce(pending_count, 0) AS pending_count, CAST(coalesce(pending_total, 0) AS {M}) AS pending_total,
 coalesce(cancelled_count, 0) AS cancelled_count, CAST(coalesce(cancelled_total, 0) AS {M}) AS cancelled_total, CAST(s.opening_cash + coalesce(cash, 0) AS {M}) AS expected_cash, s.counted_cash
 FROM pos_shifts s LEFT JOIN st ON st.shift_id = s.id LEFT JOIN pos_admins a ON a.id = s.admin_id LEFT JOIN pos_admins c ON c.id = s.closed_by""",
    rd=f"SELECT *, CASE WHEN closed_at IS NOT NULL THEN CAST(counted_cash - expected_cash AS {M}) END AS difference FROM rc",
)
DIFF_LABEL = "CASE WHEN difference IS NULL THEN NULL WHEN abs(difference) < 0.005 THEN 'Exact match' WHEN difference < 0 THEN 'Short by' ELSE 'Over by' END"


@query("shift_totals", "SELECT * FROM st", **SHIFT)
def shift_totals(t):
    return H.shift_totals(H.shift_orders(t.shifts, t.orders, AS_OF))


@query("shift_reconcile", f"SELECT *, {DIFF_LABEL} AS label FROM rd", **SHIFT)
def shift_reconcile(t):
    return H.reconcile(t.shifts, t.orders, t.admins, AS_OF)


@query("shifts_in_range", f"SELECT *, {DIFF_LABEL} AS label FROM rd WHERE {ONE_YEAR_SHIFTS} ORDER BY opened_at DESC, id DESC LIMIT 200", **SHIFT)
def shifts_in_range(t):
    return H.reconcile(P.shifts_in_range(t.shifts, ONE_YEAR), t.orders, t.admins, AS_OF)


@query("cash_diff_label", "SELECT id, CASE WHEN d = 0 THEN 'Exact match' WHEN d < 0 THEN 'Short by' ELSE 'Over by' END AS label FROM (SELECT id, CAST((id % 3 - 1) * total AS DECIMAL(12,2)) AS d FROM pos_orders)")
def cash_diff(t):
    return t.orders.select("id", labels.cash_diff_label(((F.col("id") % 3 - 1) * F.col("total")).cast("decimal(12,2)")).alias("label"))


# ---- kitchen --------------------------------------------------------------

WIDE = 24 * 60  # the whole stretch before the as-of time, so lanes overflow on small data
OPEN = "kitchen_status IN ('new','preparing','ready') AND payment_status <> 'cancelled'"
LANE_KEY = "CASE WHEN kitchen_status = 'ready' THEN -epoch_us(kitchen_updated_at) ELSE epoch_us(created_at) END"
LANE = "CASE kitchen_status WHEN 'new' THEN 'queued' ELSE kitchen_status END"


def board_sql(hours: int, as_of: str = AS_OF_SQL) -> str:
    return f"""SELECT id, {LANE} AS lane, pos, created_at, kitchen_updated_at FROM (SELECT *, row_number() OVER (PARTITION BY kitchen_status ORDER BY {LANE_KEY}, id) AS pos
 FROM pos_orders WHERE {OPEN} AND created_at > {as_of} - INTERVAL '{hours}' HOUR) WHERE pos <= 12"""


@query("lane_top_n", board_sql(WIDE))
def lane_top_n(t):
    return K.lane_top_n(K.open_orders(t.orders_since(AS_OF - timedelta(hours=WIDE)), AS_OF, WIDE)).select("id", "lane", "pos", "created_at", "kitchen_updated_at")


@query("public_kitchen", f"SELECT o.*, {NESTED} AS items FROM bd o", bd=board_sql(12))
def public_kitchen(t):
    return B.public_kitchen(t.orders_since(AS_OF - timedelta(hours=12)), t.numbered_items, AS_OF)


@query(
    "today_counters",
    f"SELECT count(*) AS orders_today, count(*) FILTER (kitchen_status = 'served') AS served_today FROM pos_orders WHERE payment_status <> 'cancelled' AND created_at >= TIMESTAMP '1998-06-30 18:30:00'",
)
def today_counters(t):
    return K.today_counters(t.orders_since(DayRange.resolve(as_of=AS_OF).start), AS_OF)


QUEUE = dict(
    kq=f"""SELECT * FROM (SELECT *, 'active' AS board FROM pos_orders WHERE kitchen_status <> 'served' AND payment_status <> 'cancelled' AND created_at > {AS_OF_SQL} - INTERVAL '24' HOUR ORDER BY created_at, id LIMIT 100)
 UNION ALL SELECT * FROM (SELECT *, 'served' AS board FROM pos_orders WHERE kitchen_status = 'served' AND payment_status <> 'cancelled' AND kitchen_updated_at > {AS_OF_SQL} - INTERVAL '2' HOUR ORDER BY kitchen_updated_at DESC, id DESC LIMIT 10)"""
)


@query("kitchen_queue", "SELECT id, board, kitchen_status, created_at FROM kq", **QUEUE)
def kitchen_queue(t):
    return K.kitchen_queue(t.orders_since(AS_OF - timedelta(hours=24)), AS_OF).select("id", "board", "kitchen_status", "created_at")


AGE_SQL = f"CAST(greatest((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) // 60000000, 0) AS BIGINT)"


@query(
    "kitchen_board",
    f"""SELECT id, board, customer_name, kitchen_status, payment_status, created_at, {AGE_SQL} AS minutes,
 CASE WHEN {AGE_SQL} >= 25 THEN 'very-late' WHEN {AGE_SQL} >= 15 THEN 'late' ELSE 'on-time' END AS late, {NESTED} AS items FROM kq o""",
    **QUEUE,
)
def kitchen_board(t):
    return B.kitchen_board(t.orders_since(AS_OF - timedelta(hours=24)), t.numbered_items, AS_OF)


@query(
    "kitchen_lane_counts",
    f"SELECT lane, count(*) AS orders FROM (SELECT {LANE} AS lane FROM pos_orders WHERE {OPEN} UNION ALL SELECT 'cooking' FROM pos_orders WHERE {OPEN} AND kitchen_status <> 'ready') GROUP BY 1",
)
def kitchen_lane_counts(t):
    return K.lane_counts(t.orders.filter(K.not_cancelled()))


@query("status_change_pairs", CHANGES.format(c="payment_status", w=""))
def status_change_pairs(t):
    return K.status_changes(t.status_events, "payment_status")


STEP = "list_position(['new','preparing','ready','served'], new) - list_position(['new','preparing','ready','served'], old)"


@query(
    "kitchen_transition",
    f"SELECT *, CASE WHEN {STEP} = 1 THEN 'next' WHEN {STEP} = -1 THEN 'back' ELSE 'jump' END AS move FROM c",
    c=CHANGES.format(c="kitchen_status", w="WHERE payment_status <> 'cancelled'"),
)
def kitchen_transition(t):
    return K.kitchen_transitions(t.status_events)


@query(
    "payment_transition",
    """SELECT order_id, max_by(payment_status, ts) AS payment_status, min(created_at) FILTER (payment_status = 'paid' AND (reset IS NULL OR ts > reset)) AS paid_at
 FROM (SELECT *, {'c': created_at, 'i': id} AS ts, max(CASE WHEN payment_status = 'pending' THEN {'c': created_at, 'i': id} END) OVER (PARTITION BY order_id) AS reset FROM pos_status_events) GROUP BY 1""",
)
def payment_transition(t):
    return K.payment_fold(t.status_events)


EARLIER = "1998-06-30 12:00:00"
EARLIER_SQL = f"TIMESTAMP '{EARLIER}'"


def snapshots(t):
    """The board now and a day earlier, over all bills created up to each time."""
    at = lambda ts: K.open_orders(t.orders_since(datetime.fromisoformat(str(ts)) - timedelta(hours=WIDE)), ts, WIDE).filter(F.col("created_at") <= F.lit(ts).cast("timestamp_ntz"))
    return at("1998-07-01 12:00:00"), at(EARLIER)


SNAP = f"SELECT * FROM pos_orders WHERE {OPEN} AND created_at > {{ts}} - INTERVAL '{WIDE}' HOUR AND created_at <= {{ts}}"


@query("new_since_last", "SELECT id, kitchen_status, created_at FROM a WHERE (id, kitchen_status) NOT IN (SELECT id, kitchen_status FROM z)", a=SNAP.format(ts=AS_OF_SQL), z=SNAP.format(ts=EARLIER_SQL))
def new_since_last(t):
    now, before = snapshots(t)
    return K.new_since_last(now, before).select("id", "kitchen_status", "created_at")


def lanes(snap: str) -> str:
    return f"SELECT id, {LANE} AS lane, pos FROM (SELECT *, row_number() OVER (PARTITION BY kitchen_status ORDER BY {LANE_KEY}, id) AS pos FROM {snap}) WHERE pos <= 12"


@query(
    "board_delta",
    """SELECT id, lane, CASE lane WHEN 'ready' THEN 'Order #' || CAST(id AS VARCHAR) || ' is ready' WHEN 'preparing' THEN 'Order #' || CAST(id AS VARCHAR) || ' is being prepared' ELSE 'New order #' || CAST(id AS VARCHAR) END AS text
 FROM la WHERE (id, lane) NOT IN (SELECT id, lane FROM lz) ORDER BY CASE lane WHEN 'ready' THEN 1 WHEN 'preparing' THEN 2 ELSE 3 END, pos LIMIT 1""",
    a=SNAP.format(ts=AS_OF_SQL),
    z=SNAP.format(ts=EARLIER_SQL),
    la=lanes("a"),
    lz=lanes("z"),
)
def board_delta(t):
    now, before = snapshots(t)
    return K.board_delta(K.lane_top_n(now), K.lane_top_n(before))


# ---- pages and lists ------------------------------------------------------


@query(
    "orders_page",
    "SELECT o.id, o.phone, o.total, a.username AS author, o.created_at FROM (SELECT * FROM pos_orders ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50) o LEFT JOIN pos_admins a ON a.id = o.created_by",
)
def orders_page(t):
    return P.orders_page(t.orders, t.admins, None, 25, 50).select("id", "phone", "total", "author", "created_at")


SEARCH = "phone LIKE '%99%' OR customer_name ILIKE '%99%' OR CAST(id AS VARCHAR) = '99'"


@query(
    "order_search_page",
    f"SELECT o.id, o.phone, o.customer_name, o.total, o.payment_status, a.username AS author, o.created_at, {NESTED} AS items FROM (SELECT * FROM pos_orders WHERE {SEARCH} ORDER BY created_at DESC, id DESC LIMIT 25) o LEFT JOIN pos_admins a ON a.id = o.created_by",
)
def order_search_page(t):
    orders = t.orders.withColumn("coupon_code", F.lit(None).cast("string"))
    return B.order_search_page(orders, t.admins, t.numbered_items, "99")


@query("filtered_total_count", f"SELECT count(*) AS total_count, CAST(greatest((count(*) + 24) // 25, 1) AS BIGINT) AS pages FROM pos_orders WHERE {SEARCH}")
def filtered_total_count(t):
    return P.page_counts(t.orders.withColumn("coupon_code", F.lit(None).cast("string")).filter(P.order_matches("99")), 25)


@query(
    "pending_orders",
    f"SELECT o.id, o.total, a.username AS author, o.created_at, CAST((SELECT count(*) FROM pos_order_items i WHERE i.order_id = o.id) AS INTEGER) AS lines, coalesce({NESTED}, '') AS items FROM (SELECT * FROM pos_orders WHERE payment_status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 50) o LEFT JOIN pos_admins a ON a.id = o.created_by",
)
def pending_orders(t):
    return B.pending_page(t.orders, t.admins, t.numbered_items)


@query(
    "orders_by_phone",
    """SELECT phone, pos, id, total, payment_status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY created_at DESC, id DESC) AS pos FROM pos_orders WHERE phone IS NOT NULL) WHERE pos <= 100""",
)
def orders_by_phone(t):
    return P.newest_per_phone(t.orders).select("phone", "pos", "id", "total", "payment_status", "created_at")


@query(
    "phone_history",
    f"SELECT o.id, o.customer_name, o.total, o.payment_status, o.payment_method, o.created_at, {NESTED} AS items FROM (SELECT * FROM pos_orders WHERE phone = '9000000042' ORDER BY created_at DESC, id DESC LIMIT 100) o",
)
def phone_history(t):
    return B.phone_history(t.orders, t.numbered_items, "90000-00042")


@query(
    "customer_spend",
    f"""SELECT phone, count(*) AS orders, CAST(coalesce(sum(total) FILTER (payment_status <> 'cancelled'), 0) AS {M}) AS total, CAST(coalesce(sum(total) FILTER (payment_status <> 'cancelled' AND pos <= 100), 0) AS {M}) AS shown_total
 FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY created_at DESC, id DESC) AS pos FROM pos_orders WHERE phone IS NOT NULL) GROUP BY 1""",
)
def customer_spend(t):
    """Spend over all bills, and over the newest hundred that a customer is shown."""
    shown = B.customer_spend(P.newest_per_phone(t.orders)).select("phone", F.col("total").alias("shown_total"))
    return B.customer_spend(t.orders).join(shown, "phone")


@query("order_document", "SELECT o.id AS order_id, o.phone, o.customer_name, o.discount, o.total, o.payment_status, a.username AS author, i.line_no, i.item_name AS name, i.price, i.qty FROM pos_orders o LEFT JOIN pos_order_items i ON i.order_id = o.id LEFT JOIN pos_admins a ON a.id = o.created_by")
def order_document(t):
    return B.order_documents(t.orders, t.numbered_items(), t.admins)


@query("bill_subtotal", f"SELECT order_id, CAST(sum(price * qty) AS {M}) AS subtotal FROM pos_order_items GROUP BY 1")
def bill_subtotal(t):
    return t.order_items.groupBy("order_id").agg(F.sum(F.col("price") * F.col("qty")).cast("decimal(24,2)").alias("subtotal"))


@query("bill_item_qty", "SELECT order_id, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS lines FROM pos_order_items GROUP BY 1")
def bill_item_qty(t):
    return t.order_lines.groupBy("order_id").agg(F.sum("qty").alias("qty"), F.count("*").alias("lines"))


@query("menu_categories", "SELECT DISTINCT category FROM pos_menu_items WHERE is_active")
def menu_categories(t):
    return P.menu_categories(t.menu.filter("is_active"))


@query("menu_listing", "SELECT id, name, category, price FROM pos_menu_items WHERE is_active")
def menu_listing(t):
    return P.menu_listing(t.menu).select("id", "name", "category", "price")


@query("ingredient_listing", "SELECT id, name, unit, stock, (SELECT count(*) FROM pos_menu_item_ingredients r WHERE r.ingredient_id = i.id) AS used_count FROM pos_ingredients i")
def ingredient_listing(t):
    return P.ingredient_listing(t.ingredients, t.recipes).select("id", "name", "unit", "stock", "used_count")


@query("ingredient_used_count", "SELECT ingredient_id, count(*) AS used_count FROM pos_menu_item_ingredients GROUP BY 1")
def ingredient_used_count(t):
    return t.recipes.groupBy("ingredient_id").agg(F.count("*").alias("used_count"))


@query("coupon_listing", "SELECT id, code, is_active, created_at FROM pos_coupons ORDER BY is_active DESC, created_at DESC")
def coupon_listing(t):
    return t.coupons.select("id", "code", "is_active", "created_at").orderBy(F.desc("is_active"), F.desc("created_at"), F.desc("id"))


@query(
    "recipe_map",
    "SELECT r.menu_item_id, string_agg(CAST(i.id AS VARCHAR) || ':' || i.name || ':' || CAST(r.qty AS VARCHAR) || ' ' || i.unit, ', ' ORDER BY lower(i.name)) AS recipe FROM pos_menu_item_ingredients r JOIN pos_ingredients i ON i.id = r.ingredient_id GROUP BY 1",
)
def recipe_map(t):
    from tillworks.operators.maintain import recipe_map as build

    text = lambda e: F.concat(e["ingredient_id"].cast("string"), F.lit(":"), e["name"], F.lit(":"), e["qty"].cast("string"), F.lit(" "), e["unit"])
    return build(t.recipes, t.ingredients).select("menu_item_id", F.array_join(F.transform("recipe", text), ", ").alias("recipe"))


@query(
    "array_distinct_agg",
    "SELECT category, string_agg(DISTINCT CAST(id % 7 AS VARCHAR), ',' ORDER BY CAST(id % 7 AS VARCHAR)) AS ids, string_agg(DISTINCT trim(p[1]), ',' ORDER BY trim(p[1])) AS initials FROM (SELECT id, category, name AS p FROM pos_menu_items) GROUP BY 1",
)
def array_distinct_agg(t):
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.menu.groupBy("category").agg(distinct((F.col("id") % 7).cast("string")).alias("ids"), distinct(F.trim(F.substring("name", 1, 1))).alias("initials"))


@query(
    "public_menu",
    f"""SELECT m.id, m.name, m.category, m.price, coalesce(ms.status, 'ok') AS stock, CAST(f.favourite AS INTEGER) AS favourite FROM pos_menu_items m LEFT JOIN ms ON ms.menu_item_id = m.id
 LEFT JOIN (SELECT menu_item_id, row_number() OVER (ORDER BY qty DESC, menu_item_id) AS favourite FROM fv) f ON f.menu_item_id = m.id WHERE m.is_active""",
    **STOCK,
    fv=f"""SELECT i.menu_item_id, sum(i.qty) AS qty FROM pos_order_items i JOIN pos_orders o ON o.id = i.order_id JOIN pos_menu_items m ON m.id = i.menu_item_id AND m.is_active
 WHERE o.payment_status = 'paid' AND o.created_at > {AS_OF_SQL} - INTERVAL '7' DAY GROUP BY 1 ORDER BY qty DESC, menu_item_id LIMIT 6""",
)
def public_menu(t):
    return B.public_menu(t.menu, t.recipes, t.ingredients, t.orders_since(AS_OF - R.LIKED), t.order_lines, AS_OF)
