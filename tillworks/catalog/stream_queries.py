"""Streaming jobs drained over the given tables; checked against their batch twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog.board_queries import LEDGER, QUEUE, SHIFT
from tillworks.catalog.params import AS_OF, EVENTS_AS_OF, EVENTS_AS_OF_SQL
from tillworks.catalog.registry import query
from tillworks.sources.adapters import Tables
from tillworks.streaming import guard, jobs
from tillworks.streaming.feeds import new_run, stream_raw


class Streams(Tables):
    """The same shop tables, read as streams."""

    def raw(self, name):
        return stream_raw(self.spark, self.folder, name)


def live(t):
    return Streams(t.spark, t.folder)


@query(
    "order_change_feed",
    "SELECT order_id, max_by(payment_status, (created_at, id)) AS payment_status, max_by(kitchen_status, (created_at, id)) AS kitchen_status, max(created_at) AS changed_at, count(*) AS changes FROM pos_status_events GROUP BY 1",
)
def order_change_feed(t):
    return jobs.order_change_feed(live(t).status_events, new_run(t.spark, "order-changes"))


@query("stream_kitchen_board", "SELECT id, board, kitchen_status, created_at FROM kq", **QUEUE)
def stream_kitchen_board(t):
    return jobs.kitchen_board(live(t).orders, new_run(t.spark, "kitchen-board"), AS_OF).select("id", "board", "kitchen_status", "created_at")


@query("stream_new_orders", "SELECT id, created_at FROM pos_orders")
def stream_new_orders(t):
    out = jobs.new_orders(live(t).orders, new_run(t.spark, "new-orders"))
    return out.select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(
    "stream_login_alerts",
    f"""SELECT l.id, l.username, l.ip, l.created_at, coalesce(a.role, 'admin') AS role FROM pos_login_attempts l LEFT JOIN pos_admins a ON lower(a.username) = l.username
 WHERE l.succeeded AND l.username <> 'staff10' AND l.created_at > {EVENTS_AS_OF_SQL} - INTERVAL '1' HOUR""",
)
def stream_login_alerts(t):
    return jobs.login_alerts(live(t).logins, t.admins, new_run(t.spark, "login-alerts"), EVENTS_AS_OF, "staff10")


@query("stream_stock", "SELECT * FROM lg", **LEDGER)
def stream_stock(t):
    return jobs.stock(live(t).stock_events, t.ingredients, new_run(t.spark, "stock"))


@query(
    "stream_low_stock",
    """SELECT lg.id, lg.ingredient_id, lg.balance_after, lg.created_at FROM lg JOIN pos_ingredients i ON i.id = lg.ingredient_id AND i.track_stock
 WHERE lg.balance_after <= coalesce(i.low_stock_at, 0) AND lg.balance_after - lg.qty > coalesce(i.low_stock_at, 0)""",
    **LEDGER,
)
def stream_low_stock(t):
    moves = jobs.stock(live(t).stock_events, t.ingredients, new_run(t.spark, "low-stock"))
    return jobs.low_stock_crossings(moves, t.ingredients)


@query(
    "stream_sales_day_hour",
    """SELECT 'hour' AS grain, time_bucket(INTERVAL '1' HOUR, created_at, TIMESTAMP '1990-01-01 00:30:00') AS start, count(*) AS orders, CAST(sum(total) AS DECIMAL(24,2)) AS total FROM pos_orders WHERE payment_status = 'paid' GROUP BY 2
 UNION ALL SELECT 'day', time_bucket(INTERVAL '1' DAY, created_at, TIMESTAMP '1990-01-01 18:30:00'), count(*), CAST(sum(total) AS DECIMAL(24,2)) FROM pos_orders WHERE payment_status = 'paid' GROUP BY 2""",
)
def stream_sales_day_hour(t):
    """Bills that end cancelled come paid first, so every cancellation has something to take back."""
    status = F.col("payment_status")
    versions = F.when(status == "cancelled", F.array(F.lit("paid"), status)).otherwise(F.array(status))
    return jobs.sales_day_hour(live(t).orders.withColumn("payment_status", F.explode(versions)), new_run(t.spark, "sales"))


@query("stream_shift_totals", "SELECT * FROM st", **SHIFT)
def stream_shift_totals(t):
    return jobs.shift_totals(live(t).orders, t.shifts, new_run(t.spark, "shift-totals"), AS_OF)


#: Try by try in time order; ``held`` are the let-through failures, ``live`` until the user's next success.
TRIES = dict(
    t="SELECT row_number() OVER (ORDER BY created_at, id) AS n, id, username, ip, succeeded, epoch_us(created_at) AS us FROM pos_login_bursts",
    rc="""SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS lock, CAST(NULL AS BIGINT) AS wait_minutes,
 CAST([] AS STRUCT(u VARCHAR, a VARCHAR, us BIGINT, live BOOLEAN)[]) AS held, CAST([] AS STRUCT(u VARCHAR, us BIGINT)[]) AS good
 UNION ALL SELECT n, id, username, ip, lock, CASE WHEN lock = 'user' THEN greatest((mine[-5].us + 900000000 - us + 59999999) // 60000000, 1) END,
 CASE WHEN lock IS NOT NULL THEN held WHEN succeeded THEN list_transform(held, lambda h: {'u': h.u, 'a': h.a, 'us': h.us, 'live': h.live AND h.u <> username})
 ELSE list_append(held, {'u': username, 'a': ip, 'us': us, 'live': len(list_filter(good, lambda g: g.u = username AND g.us = us)) = 0}) END,
 CASE WHEN lock IS NULL AND succeeded THEN list_append(list_filter(good, lambda g: g.us = us), {'u': username, 'us': us}) ELSE good END FROM
 (SELECT *, CASE WHEN len(mine) >= 5 THEN 'user' WHEN len(list_filter(held, lambda h: h.a = ip)) >= 20 THEN 'ip' END AS lock FROM
 (SELECT *, list_filter(held, lambda h: h.live AND h.u = username) AS mine FROM
 (SELECT t.*, list_filter(rc.held, lambda h: h.us > t.us - 900000000) AS held, rc.good FROM rc JOIN t ON t.n = rc.n + 1)))""",
)


@query("stream_login_lockout", "SELECT id, username, ip, lock, wait_minutes FROM rc WHERE n > 0", **TRIES)
def stream_login_lockout(t):
    """Both rules over one stream of raw tries."""
    return guard.guard(live(t).login_bursts, new_run(t.spark, "login-guard")).select("id", "username", "ip", "lock", "wait_minutes")


@query("stream_ip_lockout", "SELECT ip AS key, count(*) AS tries, count(*) FILTER (lock = 'ip') AS refused, count(*) FILTER (lock = 'user') AS refused_for_user FROM rc WHERE n > 0 GROUP BY 1", **TRIES)
def stream_ip_lockout(t):
    """What became of the tries of each address."""
    decided = guard.guard(live(t).login_bursts, new_run(t.spark, "address-guard"))
    return decided.groupBy(F.col("ip").alias("key")).agg(F.count("*").alias("tries"), F.count_if(F.col("lock") == "ip").alias("refused"), F.count_if(F.col("lock") == "user").alias("refused_for_user"))


@query(
    "stream_late_orders",
    """SELECT id AS order_id, mark FROM pos_orders, (VALUES ('late', 15), ('very-late', 25)) m(mark, n) WHERE kitchen_status <> 'served' AND payment_status <> 'cancelled'
 AND epoch_us(created_at) // 1000 + n * 60000 <= (SELECT max(epoch_us(created_at)) // 1000 FROM pos_orders)""",
)
def stream_late_orders(t):
    events = live(t).orders.select(F.col("id").alias("order_id"), "created_at", "kitchen_status", "payment_status", F.col("created_at").alias("ts"))
    return jobs.late_orders(events, new_run(t.spark, "late-orders"))


@query(
    "stream_pending_logins",
    """SELECT session_id, state, at_ms FROM (SELECT id AS session_id, 'waiting' AS state, epoch_us(created_at) // 1000 AS at_ms FROM pos_sessions
 UNION ALL SELECT id, CASE WHEN id % 4 = 2 THEN 'denied' ELSE 'approved' END, epoch_us(created_at + INTERVAL '5' MINUTE) // 1000 FROM pos_sessions WHERE id % 4 <> 0
 UNION ALL SELECT id, 'signed out', epoch_us(created_at + INTERVAL '3' HOUR) // 1000 FROM pos_sessions WHERE id % 4 = 3
 UNION ALL SELECT id, 'expired', epoch_us(created_at) // 1000 + 43200000 FROM pos_sessions WHERE id % 4 IN (0, 1) AND epoch_us(created_at) // 1000 + 43200000 < (SELECT max(epoch_us(ts)) // 1000 - 10800000 FROM pos_session_events))""",
)
def stream_pending_logins(t):
    return jobs.pending_logins(live(t).session_events, new_run(t.spark, "pending-logins"))
