"""Sign-in analytics: alerts, lockouts, sessions and the staff list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import access
from tillworks.functions import timeutil as T
from tillworks.operators.prefix import marks_before, running_last, running_sum

LOCK_WINDOW_US = 15 * T.MINUTE_US
USER_LIMIT = 5
IP_LIMIT = 20
SESSION_HOURS = 12


def login_cursor(logins: DataFrame) -> DataFrame:
    return logins.filter("succeeded").agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def logins_after(logins: DataFrame, admins: DataFrame, cursor: int, as_of, n: int = 20) -> DataFrame:
    """Successful sign-ins newer than the cursor and younger than an hour, oldest first."""
    fresh = F.col("succeeded") & (F.col("id") > cursor) & (F.col("created_at") > T.instant(as_of) - F.expr("interval 1 hour"))
    rows = logins.filter(fresh).orderBy("id").limit(n)
    return with_role(rows, admins).select("id", "username", "ip", "created_at", "role")


def with_role(logins: DataFrame, admins: DataFrame) -> DataFrame:
    """Role of the account a username belongs to; unknown names count as plain admins."""
    roles = admins.select(F.lower("username").alias("_key"), "role")
    return logins.join(roles, F.col("username") == F.col("_key"), "left").drop("_key").withColumn("role", F.coalesce("role", F.lit("admin")))


def failures_in_window(attempts: DataFrame) -> DataFrame:
    """Per recorded attempt, what the rate limit saw just before it.

    ``user_failures``: failures of the user since their last success within fifteen
    minutes; ``ip_failures``: failures from the address in fifteen minutes;
    ``fifth_failure_us``: when the fifth most recent of the user's failures happened.

    Ids are distinct; an attempt without an address (or username) counts no failures of one. Both
    counts are differences of running counts at the ends of the look-back, so no task
    holds a key's attempts: a user or address under attack is spread over its minutes.
    """
    tries = attempts.withColumn("_us", T.micros(F.col("created_at")))
    minute = F.floor(F.col("_us") / T.MINUTE_US)
    # The last success before each attempt; at one instant attempts come before successes.
    asked = tries.filter("username is not null").select("id", "username", "ip", "_us", F.lit(0).alias("_mark"), F.lit(None).cast("bigint").alias("_good"))
    good = tries.filter("succeeded and username is not null").select("id", "username", "ip", "_us", F.lit(1).alias("_mark"), F.col("_us").alias("_good"))
    seen = running_last(asked.unionByName(good), ["username"], ["_us", "_mark"], minute, "_good", "_ok").filter("_mark = 0")
    first = F.col("_us") - (LOCK_WINDOW_US - 1)
    by_user = seen.select("id", F.lit("user").alias("_rule"), F.col("username").alias("_who"), "_us", F.greatest(first, F.col("_ok") + 1).alias("_from"))
    by_ip = tries.filter("ip is not null").select("id", F.lit("ip").alias("_rule"), F.col("ip").alias("_who"), "_us", first.alias("_from"))
    ends = F.array(F.struct(F.lit(1).alias("_sign"), F.col("_us").alias("_at")), F.struct(F.lit(-1).alias("_sign"), F.col("_from").alias("_at")))
    probes = by_user.unionByName(by_ip).select("id", "_rule", "_who", F.inline(ends))
    rules = F.array(*[F.struct(F.lit(rule).alias("_rule"), F.col(c).alias("_who")) for rule, c in (("user", "username"), ("ip", "ip"))])
    marks = tries.filter(~F.col("succeeded")).select(F.col("_us").alias("_at"), F.inline(rules)).filter("_who is not null")
    counted, numbered = marks_before(probes, marks, ["_rule", "_who"], "_at", T.MINUTE_US, "_n")
    within = lambda rule: F.coalesce(F.sum(F.when(F.col("_rule") == rule, F.col("_sign") * F.col("_n"))), F.lit(0))
    found = counted.groupBy("id").agg(
        within("user").alias("user_failures"), within("ip").alias("ip_failures"), F.max(F.when((F.col("_rule") == "user") & (F.col("_sign") == 1), F.col("_n"))).alias("_upto")
    )
    rows = tries.join(found, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("user_failures", "ip_failures")})
    # Attempts without a fifth failure look up a place of their own, so that they do not meet in one task.
    rows = rows.withColumn("_fifth", F.when(F.col("user_failures") >= USER_LIMIT, F.col("_upto") - (USER_LIMIT - 1)).otherwise(-1 - F.abs("id")))
    places = numbered.filter("_rule = 'user'").select(F.col("_who").alias("_name"), F.col("_n").alias("_fifth"), F.col("_at").alias("fifth_failure_us"))
    rows = rows.join(places.withColumnRenamed("_fifth", "_place"), (F.col("username") == F.col("_name")) & (F.col("_fifth") == F.col("_place")), "left")
    return rows.select(*attempts.columns, "user_failures", "fifth_failure_us", "ip_failures")


def lockouts(attempts: DataFrame) -> DataFrame:
    """Lock decision per recorded attempt: user rule first, then the address rule."""
    seen = failures_in_window(attempts)
    locked = F.col("user_failures") >= USER_LIMIT
    left = F.col("fifth_failure_us") + LOCK_WINDOW_US - T.micros(F.col("created_at"))
    return seen.select(
        *attempts.columns,
        "user_failures",
        "ip_failures",
        F.when(locked, "user").when(F.col("ip_failures") >= IP_LIMIT, "ip").alias("lock"),
        F.when(locked, wait_minutes(left)).alias("wait_minutes"),
    )


def wait_minutes(left_us: Column) -> Column:
    return F.greatest(F.ceil(left_us / T.MINUTE_US), F.lit(1)).cast("bigint")


def locked_users(attempts: DataFrame, as_of) -> DataFrame:
    """Users locked at ``as_of`` with the minutes left: their fifth most recent failure decides.

    Only the last quarter hour is read; at most five failures per user and map task
    reach the window.
    """
    now = T.instant(as_of)
    recent = attempts.filter((F.col("created_at") > now - F.expr("interval 15 minutes")) & (F.col("created_at") < now))
    success = recent.filter("succeeded").groupBy("username").agg(F.max("created_at").alias("_ok"))
    failures = recent.filter(~F.col("succeeded")).join(success, "username", "left").filter("_ok is null or created_at > _ok")
    w = Window.partitionBy("username").orderBy(F.desc("created_at"), F.desc("id"))
    fifth = failures.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= USER_LIMIT).filter(F.col("_n") == USER_LIMIT)
    left = F.timestamp_diff("MICROSECOND", now, F.col("created_at")) + LOCK_WINDOW_US
    return fifth.select("username", F.col("created_at").alias("fifth_failure"), wait_minutes(left).alias("wait_minutes"))


def failure_counts(attempts: DataFrame, as_of) -> DataFrame:
    """Failures per user (since the last success) and per address in the last quarter hour."""
    now = T.instant(as_of)
    recent = attempts.filter((F.col("created_at") > now - F.expr("interval 15 minutes")) & (F.col("created_at") < now))
    success = recent.filter("succeeded").groupBy("username").agg(F.max("created_at").alias("_ok"))
    failed = recent.filter(~F.col("succeeded"))
    users = failed.join(success, "username", "left").filter("_ok is null or created_at > _ok")
    per_user = users.groupBy(F.col("username").alias("key")).agg(F.count("*").alias("failures")).withColumn("kind", F.lit("user"))
    per_ip = failed.filter("ip is not null").groupBy(F.col("ip").alias("key")).agg(F.count("*").alias("failures")).withColumn("kind", F.lit("ip"))
    return per_user.unionByName(per_ip)


def session_gate(events: DataFrame, sessions: DataFrame, admins: DataFrame) -> DataFrame:
    """Verdict per event ``(id, username, created_at)``: ok, expired, hours or waiting.

    How many sessions of an account are open, and how many of them approved, are running sums
    over its session starts (+1) and ends (-1), read at each event: work in proportion to
    events and sessions, however many sessions of an account overlap. A start counts from its
    own instant on, an end too. Events of unknown or inactive accounts are expired; sessions
    without both bounds or of no length never open.
    """
    who = admins.filter("is_active").withColumnRenamed("id", "_admin")
    acting = events.join(who, "username", "left")
    # Events without an account get a key of their own instead of one shared null.
    known = F.col("_admin").isNotNull()
    acting = acting.select(
        "id", "username", "role", "login_from", "login_to", "created_at", known.alias("_known"), F.coalesce(F.col("_admin").cast("bigint"), F.xxhash64("id")).alias("_key"), F.lit(True).alias("_event")
    )
    begin, end, ok = F.col("created_at"), F.col("expires_at"), F.greatest("approved_at", "created_at")
    approved = F.col("approved_at").isNotNull() & (ok < end)
    step = lambda at, opened, allowed: F.struct(at.alias("at"), F.lit(opened).alias("_open"), allowed.cast("int").alias("_allowed"))
    steps = F.array(step(begin, 1, F.lit(0)), step(end, -1, -approved.cast("int")), step(F.when(approved, ok), 0, F.lit(1)))
    marks = sessions.filter(begin < end).select(F.col("admin_id").cast("bigint").alias("_key"), F.inline(steps)).filter("at is not null and _key is not null")
    marks = marks.select("_key", F.col("at").alias("created_at"), "_open", "_allowed", F.lit(True).alias("_known"), F.lit(False).alias("_event"))
    both = acting.unionByName(marks, allowMissingColumns=True)
    minute = F.floor(T.micros(F.col("created_at")) / T.MINUTE_US)
    sums = {"_sessions": F.coalesce("_open", F.lit(0)), "_approved": F.coalesce("_allowed", F.lit(0))}
    per_event = running_sum(both, ["_known", "_key"], ["created_at", "_event"], minute, **sums).filter("_event")
    gate = access.in_login_window(F.col("role"), F.col("login_from"), F.col("login_to"), T.local_minute(F.col("created_at")))
    verdict = (
        F.when(F.col("_sessions") == 0, "expired")
        .when(F.col("role") == "super", "ok")
        .when(~gate, "hours")
        .when(F.col("_approved") == 0, "waiting")
        .otherwise("ok")
    )
    return per_event.select("id", "username", verdict.alias("verdict"))


def _gate_at(as_of) -> Column:
    return access.in_login_window(F.col("role"), F.col("login_from"), F.col("login_to"), T.local_minute(T.instant(as_of)))


def session_state(events: DataFrame, admins: DataFrame, as_of) -> DataFrame:
    """State of every session at ``as_of``, folded from sign-in events by plain aggregates."""
    now = T.instant(as_of)
    at = lambda *kinds: F.min(F.when(F.col("event").isin(*kinds), F.col("ts")))
    folded = (
        events.filter(F.col("ts") <= now)
        .groupBy("session_id", "admin_id")
        .agg(at("login").alias("created_at"), at("approve").alias("_ok"), at("deny").alias("_no"), at("logout", "revoke").alias("_out"))
        .filter("created_at is not null")
    )
    rows = folded.join(admins.withColumnRenamed("id", "admin_id"), "admin_id")
    rows = rows.withColumn("expires_at", F.timestamp_add("HOUR", F.lit(SESSION_HOURS), F.col("created_at")))
    at_once = (F.col("role") == "super") | F.col("auto_approve")
    answered = F.when(F.col("_ok") < F.col("expires_at"), F.col("_ok"))
    rows = rows.withColumn("approved_at", F.when(at_once, F.col("created_at")).otherwise(answered))
    denied = F.col("_no").isNotNull() & (F.col("approved_at").isNull() | (F.col("_no") < F.col("approved_at")))
    state = (
        F.when(denied, "denied")
        .when(F.col("_out").isNotNull(), "signed out")
        .when(F.col("expires_at") <= now, "expired")
        .when(F.col("approved_at").isNotNull(), "approved")
        .otherwise("waiting")
    )
    return rows.select("session_id", "username", "created_at", state.alias("state"), _gate_at(as_of).alias("in_window"))


def pending_logins(sessions: DataFrame, admins: DataFrame, as_of, n: int = 50) -> DataFrame:
    """Unapproved, unexpired sign-ins of active accounts inside their hours, oldest first."""
    waiting = sessions.filter(F.col("approved_at").isNull() & (F.col("expires_at") > T.instant(as_of)))
    rows = waiting.join(admins.filter("is_active").withColumnRenamed("id", "admin_id"), "admin_id").filter(_gate_at(as_of))
    return rows.orderBy("created_at", "id").limit(n).select(
        F.col("id").alias("session_id"), "username", "role", "ip", "created_at", access.window_label(F.col("login_from"), F.col("login_to")).alias("login_window")
    )


def session_counts(sessions: DataFrame, as_of) -> DataFrame:
    """Live and waiting sessions per account."""
    live = sessions.filter(F.col("expires_at") > T.instant(as_of))
    return live.groupBy("admin_id").agg(F.count("*").alias("active_sessions"), F.count_if(F.col("approved_at").isNull()).alias("waiting_sessions"))


def staff_overview(admins: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    counts = session_counts(sessions, as_of).withColumnRenamed("admin_id", "id")
    rows = admins.join(counts, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "id", "username", "role", "is_active", "login_from", "login_to", "auto_approve", _gate_at(as_of).alias("in_window"), zero("active_sessions"), zero("waiting_sessions")
    ).orderBy(F.desc("is_active"), F.lower("username"))


def attempts_after_purge(attempts: DataFrame, as_of) -> DataFrame:
    return attempts.filter(F.col("created_at") >= T.instant(as_of) - F.expr("interval 1 day"))


def sessions_after_purge(sessions: DataFrame, as_of) -> DataFrame:
    return sessions.filter(F.col("expires_at") >= T.instant(as_of))

