"""Sign-in analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.catalog.params import EVENTS_AS_OF, EVENTS_AS_OF_SQL, LOCAL
from tillworks.catalog.registry import query
from tillworks.catalog.scalar_queries import WINDOW_SQL
from tillworks.operators import access as A

BURST_AS_OF = "2024-01-01 02:46:11"
BURST_SQL = f"TIMESTAMP '{BURST_AS_OF}'"
RECENT = f"SELECT * FROM pos_login_bursts WHERE created_at > {BURST_SQL} - INTERVAL '15' MINUTE AND created_at < {BURST_SQL}"
FAILS = "SELECT r.* FROM r LEFT JOIN (SELECT username, max(created_at) AS ok FROM r WHERE succeeded GROUP BY 1) s ON s.username = r.username WHERE NOT succeeded AND (ok IS NULL OR created_at > ok)"
GATE_AT = WINDOW_SQL.format(ts=f"({EVENTS_AS_OF_SQL} + INTERVAL '330' MINUTE)")

LOCK = dict(
    u="SELECT *, epoch_us(created_at) AS us FROM pos_login_bursts",
    sg="SELECT *, count(*) FILTER (succeeded) OVER (PARTITION BY username ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM u",
    t5="SELECT *, CASE WHEN NOT succeeded THEN lag(us, 4) OVER (PARTITION BY username, seg, succeeded ORDER BY us, id) END AS f5 FROM sg",
    fw="""SELECT *, count(*) FILTER (NOT succeeded) OVER (PARTITION BY username, seg ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND 1 PRECEDING) AS user_failures,
 max(f5) OVER (PARTITION BY username, seg ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND 1 PRECEDING) AS fifth,
 count(*) FILTER (NOT succeeded) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND 1 PRECEDING) AS ip_failures FROM t5""",
)


@query(
    "failures_in_window",
    "SELECT id, username, ip, succeeded, created_at, user_failures, CASE WHEN user_failures >= 5 THEN fifth END AS fifth_failure_us, ip_failures FROM fw",
    **LOCK,
)
def failures_in_window(t):
    return A.failures_in_window(t.login_bursts)


@query(
    "login_lockout",
    """SELECT id, username, ip, succeeded, created_at, user_failures, ip_failures, CASE WHEN user_failures >= 5 THEN 'user' WHEN ip_failures >= 20 THEN 'ip' END AS lock,
 CASE WHEN user_failures >= 5 THEN CAST(greatest((fifth + 900000000 - us + 59999999) // 60000000, 1) AS BIGINT) END AS wait_minutes FROM fw""",
    **LOCK,
)
def login_lockout(t):
    return A.lockouts(t.login_bursts)


@query(
    "fifth_recent_failure",
    f"SELECT username, created_at AS fifth_failure, CAST(greatest((epoch_us(created_at) + 900000000 - epoch_us({BURST_SQL}) + 59999999) // 60000000, 1) AS BIGINT) AS wait_minutes FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY created_at DESC, id DESC) AS n FROM f) WHERE n = 5",
    r=RECENT,
    f=FAILS,
)
def fifth_recent_failure(t):
    return A.locked_users(t.login_bursts, BURST_AS_OF)


@query("login_failure_counts", "SELECT 'user' AS kind, username AS key, count(*) AS failures FROM f GROUP BY 2 UNION ALL SELECT 'ip', ip, count(*) FROM r WHERE NOT succeeded GROUP BY 2", r=RECENT, f=FAILS)
def login_failure_counts(t):
    return A.failure_counts(t.login_bursts, BURST_AS_OF).select("kind", "key", "failures")


@query("join_login_role", "SELECT l.id, l.username, coalesce(a.role, 'admin') AS role FROM pos_login_attempts l LEFT JOIN pos_admins a ON lower(a.username) = l.username WHERE l.succeeded")
def join_login_role(t):
    return A.with_role(t.logins.filter("succeeded").select("id", "username"), t.admins)


@query("recent_logins_page", "SELECT id, username, ip, created_at FROM pos_login_attempts WHERE succeeded AND id > 500 ORDER BY id LIMIT 20")
def recent_logins_page(t):
    return t.logins.filter("succeeded and id > 500").orderBy("id").limit(20).select("id", "username", "ip", "created_at")


@query(
    "session_gate",
    f"""SELECT e.id, e.admin_username AS username, CASE WHEN s.n IS NULL OR s.n = 0 THEN 'expired' WHEN a.role = 'super' THEN 'ok' WHEN NOT ({WINDOW_SQL.format(ts='e.local_at')}) THEN 'hours' WHEN NOT s.ok THEN 'waiting' ELSE 'ok' END AS verdict
 FROM (SELECT *, {LOCAL} AS local_at FROM pos_audit_log) e LEFT JOIN (SELECT * FROM pos_admins WHERE is_active) a ON a.username = e.admin_username
 LEFT JOIN (SELECT e.id, count(*) AS n, coalesce(bool_or(s.approved_at <= e.created_at), false) AS ok FROM pos_audit_log e JOIN pos_admins a ON a.username = e.admin_username AND a.is_active
 JOIN pos_sessions s ON s.admin_id = a.id AND s.created_at <= e.created_at AND e.created_at < s.expires_at GROUP BY 1) s ON s.id = e.id""",
)
def session_gate(t):
    events = t.audit.select("id", F.col("admin_username").alias("username"), "created_at")
    return A.session_gate(events, t.sessions, t.admins)


@query(
    "session_state",
    f"""SELECT session_id, username, created_at, CASE WHEN no_ts IS NOT NULL AND (approved_at IS NULL OR no_ts < approved_at) THEN 'denied' WHEN out_ts IS NOT NULL THEN 'signed out'
 WHEN created_at + INTERVAL '12' HOUR <= {EVENTS_AS_OF_SQL} THEN 'expired' WHEN approved_at IS NOT NULL THEN 'approved' ELSE 'waiting' END AS state, in_window FROM
 (SELECT f.*, a.username, {GATE_AT} AS in_window, CASE WHEN a.role = 'super' OR a.auto_approve THEN created_at WHEN ok_ts < created_at + INTERVAL '12' HOUR THEN ok_ts END AS approved_at FROM
 (SELECT session_id, admin_id, min(ts) FILTER (event = 'login') AS created_at, min(ts) FILTER (event = 'approve') AS ok_ts, min(ts) FILTER (event = 'deny') AS no_ts, min(ts) FILTER (event IN ('logout', 'revoke')) AS out_ts
 FROM pos_session_events WHERE ts <= {EVENTS_AS_OF_SQL} GROUP BY 1, 2) f JOIN pos_admins a ON a.id = f.admin_id WHERE created_at IS NOT NULL)""",
)
def session_state(t):
    return A.session_state(t.session_events, t.admins, EVENTS_AS_OF)


COUNTS = dict(c=f"SELECT admin_id, count(*) AS active_sessions, count(*) FILTER (approved_at IS NULL) AS waiting_sessions FROM pos_sessions WHERE expires_at > {EVENTS_AS_OF_SQL} GROUP BY 1")


@query("admin_session_counts", "SELECT * FROM c", **COUNTS)
def admin_session_counts(t):
    return A.session_counts(t.sessions, EVENTS_AS_OF)


STAFF = f"SELECT a.id, a.username, a.role, a.is_active, a.login_from, a.login_to, a.auto_approve, {GATE_AT} AS in_window, coalesce(active_sessions, 0) AS active_sessions, coalesce(waiting_sessions, 0) AS waiting_sessions FROM pos_admins a LEFT JOIN c ON c.admin_id = a.id"


@query("staff_overview", STAFF, **COUNTS)
def staff_overview(t):
    return A.staff_overview(t.admins, t.sessions, EVENTS_AS_OF)


@query("staff_listing", "SELECT id, username, role, is_active FROM pos_admins")
def staff_listing(t):
    return t.admins.select("id", "username", "role", "is_active").orderBy(F.desc("is_active"), F.lower("username"))


@query(
    "pending_logins",
    f"""SELECT s.id AS session_id, a.username, a.role, s.ip, s.created_at, a.login_from || ' and ' || a.login_to AS login_window FROM pos_sessions s JOIN pos_admins a ON a.id = s.admin_id
 WHERE s.approved_at IS NULL AND s.expires_at > {EVENTS_AS_OF_SQL} AND a.is_active AND {GATE_AT} ORDER BY s.created_at, s.id LIMIT 50""",
)
def pending_logins(t):
    return A.pending_logins(t.sessions, t.admins, EVENTS_AS_OF)


@query(
    "retention_purge",
    f"SELECT 'attempt' AS kind, id FROM pos_login_attempts WHERE created_at >= {EVENTS_AS_OF_SQL} - INTERVAL '1' DAY UNION ALL SELECT 'session', id FROM pos_sessions WHERE expires_at >= {EVENTS_AS_OF_SQL}",
)
def retention_purge(t):
    attempts = A.attempts_after_purge(t.logins, EVENTS_AS_OF).select(F.lit("attempt").alias("kind"), "id")
    return attempts.unionByName(A.sessions_after_purge(t.sessions, EVENTS_AS_OF).select(F.lit("session").alias("kind"), "id"))
