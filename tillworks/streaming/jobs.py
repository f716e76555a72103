"""Live jobs. Each takes a stream and returns what it has written once the input is drained.

Aggregating jobs keep their state in versioned tables inside ``foreachBatch`` and reuse the
batch operators, so a stream and a batch run give the same rows. ``last_batch`` comes from
the job itself: batch ids count up from zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions import labels
from tillworks.functions import timeutil as T
from tillworks.operators import access as A
from tillworks.operators import kitchen as K
from tillworks.operators import shifts as H
from tillworks.operators import stock as S
from tillworks.streaming.feeds import drain
from tillworks.streaming.state import BatchLog, DayLog, VersionedTable


class _Progress:
    """The last batch id a drained job has seen."""

    def __init__(self) -> None:
        self.last = -1


def order_change_feed(events: DataFrame, run: str) -> DataFrame:
    """Per batch, the orders that changed with their latest statuses."""
    out = BatchLog(f"{run}/rows", "order_id bigint, payment_status string, kitchen_status string, changed_at timestamp_ntz, changes bigint")

    def each(batch: DataFrame, n: int) -> None:
        at = F.struct("created_at", "id")
        rows = batch.groupBy("order_id").agg(
            F.max_by("payment_status", at).alias("payment_status"),
            F.max_by("kitchen_status", at).alias("kitchen_status"),
            F.max("created_at").alias("changed_at"),
            F.count("*").alias("changes"),
        )
        out.write(rows, n)

    drain(events, run, each)
    return out.read(events.sparkSession)


BOARD = "id bigint, customer_name string, payment_status string, kitchen_status string, kitchen_updated_at timestamp_ntz, created_at timestamp_ntz, version bigint"


def kitchen_board(orders: DataFrame, run: str, as_of) -> DataFrame:
    """Latest row per order of the board's day, then the staff queue as of ``as_of``.

    A batch writes its own latest rows and reads nothing; a row older than an outdated one is
    outdated too, so those never enter the log. Of rows of equal event times a
    cancellation counts, else the later batch. Cancelled orders stay, so that no late row brings them back.
    """
    out = BatchLog(f"{run}/orders", BOARD)
    columns = [c.split()[0] for c in BOARD.split(", ")]

    def latest(rows: DataFrame) -> DataFrame:
        changed = F.struct(F.greatest("kitchen_updated_at", "created_at"), F.col("payment_status").eqNullSafe("cancelled"), F.col("version"))
        rest = F.struct(*[c for c in columns if c != "id"])
        return rows.groupBy("id").agg(F.max_by(rest, changed).alias("r")).select("id", "r.*")

    def each(batch: DataFrame, n: int) -> None:
        fresh = K.since(as_of, 24) | K.since(as_of, 2, "kitchen_updated_at")
        out.write(latest(batch.filter(fresh).withColumn("version", F.lit(n).cast("bigint"))).select(columns), n)

    drain(orders, run, each)
    return K.kitchen_queue(latest(out.read(orders.sparkSession)), as_of)


def new_orders(orders: DataFrame, run: str) -> DataFrame:
    """Each new order once, however often, late or out of order it is delivered.

    An id counts as new unless an earlier batch has written it; no row is too late. An order
    keeps the time it was made, so a batch looks for its ids in its own days only.
    """
    out = DayLog(f"{run}/rows", "id bigint, created_at timestamp_ntz, day date")

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.groupBy("id").agg(F.min("created_at").alias("created_at")).withColumn("day", T.local_day(F.col("created_at")))
        out.write(rows.join(out.before(batch.sparkSession, n, rows).select("id"), "id", "left_anti"), n)

    drain(orders.select("id", "created_at"), run, each)
    return out.read(orders.sparkSession).drop("day")


def login_alerts(logins: DataFrame, admins: DataFrame, run: str, as_of, me: str) -> DataFrame:
    """Successful sign-ins of others, not older than an hour, with their role."""
    out = BatchLog(f"{run}/rows", "id bigint, username string, ip string, created_at timestamp_ntz, role string")
    recent = logins.filter(F.col("succeeded") & (F.col("username") != me) & (F.col("created_at") > T.instant(as_of) - F.expr("interval 1 hour")))

    def each(batch: DataFrame, n: int) -> None:
        out.write(A.with_role(batch, admins).select("id", "username", "ip", "created_at", "role"), n)

    drain(recent, run, each)
    return out.read(logins.sparkSession)


LEDGER = "id bigint, ingredient_id bigint, kind string, qty decimal(24,3), balance_after decimal(24,3), order_id bigint, created_at timestamp_ntz"


def stock(events: DataFrame, ingredients: DataFrame, run: str) -> DataFrame:
    """The movement ledger, batch after batch from the balances the last one left."""
    out = BatchLog(f"{run}/rows", LEDGER)
    balances, seen = VersionedTable(f"{run}/balances", "id bigint, stock decimal(24,3)"), _Progress()

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        start = ingredients.select("id", F.col("stock").cast("decimal(24,3)").alias("stock")) if n == 0 else balances.read(spark, n - 1)
        out.write(S.stock_ledger(batch, start), n)
        moved = spark.read.schema(LEDGER).parquet(f"{out.path}/batch={n}")
        last = moved.groupBy(F.col("ingredient_id").alias("id")).agg(F.max_by("balance_after", F.struct("created_at", F.col("id"))).alias("_now"))
        after = start.join(last, "id", "full_outer").select("id", F.coalesce("_now", "stock").alias("stock"))
        balances.write(after, n)
        seen.last = n

    drain(events, run, each)
    return out.read(events.sparkSession)


def low_stock_crossings(movements: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Movements that take a tracked ingredient from above its alert level to it or below."""
    level = F.coalesce(F.col("low_stock_at"), F.lit(0))
    part = ingredients.filter("track_stock").select(F.col("id").alias("ingredient_id"), "low_stock_at")
    before = F.col("balance_after") - F.col("qty")
    rows = movements.join(part, "ingredient_id").filter((F.col("balance_after") <= level) & (before > level))
    return rows.select("id", "ingredient_id", "balance_after", "created_at")


CHANGES = "id bigint, start timestamp_ntz, changed struct<at:timestamp_ntz,rank:int>, orders bigint, amount decimal(24,2), day date"


def sales_day_hour(orders: DataFrame, run: str) -> DataFrame:
    """Paid sales in tumbling local hours and days; a bill cancelled later is taken back.

    Local time is half an hour off the UTC hour, so hours start at :30 and days at 18:30.
    A batch writes signed changes: what each of its bills adds to its hour (1 or 0 bills and
    their amount) less what earlier batches have counted for the bill. The version of a bill with the latest
    event time counts, of equal times a cancelled one before a paid one before an open one, whatever
    the order they arrive in. A bill keeps the time it was made, so only its own day is looked up.
    """
    out = DayLog(f"{run}/changes", CHANGES)
    status = F.col("payment_status")
    rank = F.when(status == "cancelled", 2).when(status == "paid", 1).otherwise(0)

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.select(
            "id", "total", F.window("created_at", "1 hour", "1 hour", "30 minutes")["start"].alias("start"), F.struct(F.greatest("kitchen_updated_at", "created_at").alias("at"), rank.alias("rank")).alias("changed")
        )
        now = rows.groupBy("id").agg(F.max_by(F.struct("start", "total"), "changed").alias("r"), F.max("changed").alias("changed"))
        now = now.select("id", "r.*", "changed", T.local_day(F.col("r.start")).alias("day"))
        earlier = out.before(batch.sparkSession, n, now).groupBy("id").agg(F.max("changed").alias("_seen"), F.sum("orders").alias("_orders"), F.sum("amount").alias("_amount"))
        news = now.join(earlier, "id", "left").filter(F.col("_seen").isNull() | (F.col("changed") > F.col("_seen")))
        paid = F.col("changed.rank") == 1
        less = lambda now, counted, kind: (F.when(paid, now).otherwise(0) - F.coalesce(counted, F.lit(0))).cast(kind)
        out.write(
            news.select("id", "start", "changed", less(F.lit(1), F.col("_orders"), "bigint").alias("orders"), less(F.col("total"), F.col("_amount"), "decimal(24,2)").alias("amount"), "day"), n
        )

    drain(orders.select("id", "total", "payment_status", "kitchen_updated_at", "created_at"), run, each)
    money = lambda: F.sum("total").cast("decimal(24,2)").alias("total")
    changes = out.read(orders.sparkSession).withColumnRenamed("amount", "total")
    hours = changes.groupBy("start").agg(F.sum("orders").alias("orders"), money()).filter("orders <> 0")
    # A local day is exactly twenty-four of the hours, so days come from the few hour rows.
    midnight = F.timestamp_add("MINUTE", F.lit(-330), T.local_day(F.col("start")).cast("timestamp_ntz"))
    days = hours.groupBy(midnight.alias("start")).agg(F.sum("orders").alias("orders"), money())
    return hours.select(F.lit("hour").alias("grain"), "*").unionByName(days.select(F.lit("day").alias("grain"), "*"))


def shift_totals(orders: DataFrame, shifts: DataFrame, run: str, as_of) -> DataFrame:
    """Totals per shift: each batch writes the sums of its own bills, which add up when they are read."""
    columns = ["shift_id", *H.TOTALS]
    kind = {c: ("bigint" if c in ("shift_id", "orders") or c.endswith("count") else "decimal(24,2)") for c in columns}
    out = BatchLog(f"{run}/totals", ", ".join(f"{c} {k}" for c, k in kind.items()))

    def each(batch: DataFrame, n: int) -> None:
        out.write(H.shift_totals(H.shift_orders(shifts, batch, as_of)).select(columns), n)

    drain(orders, run, each)
    return out.read(orders.sparkSession).groupBy("shift_id").agg(*[F.sum(c).cast(kind[c]).alias(c) for c in H.TOTALS])


def _millis(c):
    return F.floor(T.micros(c) / 1000)


def _event_clock(batch: DataFrame, before: DataFrame, column: str) -> DataFrame:
    """One row ``clock_ms``: the latest event time up to and including this batch."""
    seen = batch.agg(F.max(_millis(F.col(column))).alias("clock_ms")).unionByName(before.select("clock_ms"))
    return seen.agg(F.max("clock_ms").alias("clock_ms"))


LATE_STEPS = (("late", labels.LATE_MINUTES), ("very-late", labels.VERY_LATE_MINUTES))


def late_orders(events: DataFrame, run: str) -> DataFrame:
    """Marks an order ``late`` and ``very-late`` when the stream's clock passes its thresholds unserved.

    ``events`` is ``(order_id, created_at, kitchen_status, payment_status, ts)``; the clock is the
    latest ``ts`` seen, so a replay gives the same marks. Served or cancelled orders are
    forgotten, and only orders that can still get a mark are kept between batches.
    """
    out = BatchLog(f"{run}/rows", "order_id bigint, mark string")
    waiting = VersionedTable(f"{run}/waiting", "order_id bigint, created_ms bigint, stage int")
    clock = VersionedTable(f"{run}/clock", "clock_ms bigint")

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        clock.write(_event_clock(batch, clock.read(spark, n - 1), "ts"), n)
        now = clock.read(spark, n).first()["clock_ms"]
        gone = (F.col("kitchen_status") == "served") | (F.col("payment_status") == "cancelled")
        fresh = batch.groupBy("order_id").agg(
            F.min(_millis(F.col("created_at"))).alias("created_ms"), F.max_by(gone, "ts").alias("_gone")
        )
        rows = waiting.read(spark, n - 1).join(fresh.withColumnRenamed("created_ms", "_first"), "order_id", "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
        rows = rows.select("order_id", F.coalesce("created_ms", "_first").alias("created_ms"), F.coalesce("stage", F.lit(0)).alias("stage"))
        due = lambda minutes: F.col("created_ms") + minutes * 60_000 <= F.lit(now)
        reached = sum((due(m).cast("int") for _, m in LATE_STEPS), F.lit(0))
        marks = F.array_compact(F.array(*[F.when((F.col("stage") <= i) & due(m), F.lit(name)) for i, (name, m) in enumerate(LATE_STEPS)]))
        out.write(rows.select("order_id", F.explode(marks).alias("mark")), n)
        waiting.write(rows.withColumn("stage", reached).filter(F.col("stage") < len(LATE_STEPS)), n)

    drain(events, run, each)
    return out.read(events.sparkSession)


SESSION = "session_id bigint, started_ms bigint, current string"


def pending_logins(events: DataFrame, run: str, delay_minutes: int = 180) -> DataFrame:
    """Follows each sign-in ``(session_id, event, ts)``: waiting, then approved, denied, signed out
    or expired after twelve hours by the stream's clock less a delay for late answers.

    The first answer decides; only an approved session can sign out later. Plain
    aggregates per session, with the live sessions kept between batches. Answers that come
    before their sign-in wait for it until they are a session's life and the delay behind
    the clock.
    """
    out = BatchLog(f"{run}/rows", "session_id bigint, state string, at_ms bigint")
    live = VersionedTable(f"{run}/live", SESSION)
    early = VersionedTable(f"{run}/early", "session_id bigint, event string, ts timestamp_ntz")
    clock = VersionedTable(f"{run}/clock", "clock_ms bigint")
    ttl = A.SESSION_HOURS * 3_600_000

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        clock.write(_event_clock(batch, clock.read(spark, n - 1), "ts"), n)
        now = clock.read(spark, n).first()["clock_ms"]
        at = F.struct(_millis(F.col("ts")).alias("ms"), F.col("event"))
        pick = lambda *kinds: F.min(F.when(F.col("event").isin(*kinds), at))
        at_hand = batch.select("session_id", "event", "ts").unionByName(early.read(spark, n - 1))
        known = live.read(spark, n - 1).select("session_id").unionByName(at_hand.where("event = 'login'").select("session_id"))
        waits_on = _millis(F.col("ts")) >= F.lit(now - ttl - delay_minutes * 60_000)
        early.write(at_hand.join(known, "session_id", "left_anti").filter(waits_on), n)
        fresh = at_hand.groupBy("session_id").agg(
            pick("login").alias("login"), pick("approve", "deny", "logout", "revoke").alias("answer"), pick("logout", "revoke").alias("leave")
        )
        rows = live.read(spark, n - 1).join(fresh, "session_id", "full_outer")
        began = F.col("current").isNull() & F.col("login").isNotNull()
        rows = rows.filter(began | F.col("current").isNotNull()).withColumn("_began", began)
        rows = rows.withColumn("started_ms", F.coalesce("started_ms", "login.ms"))
        waits = F.coalesce("current", F.lit("waiting")) == "waiting"
        answer = F.when(waits, F.col("answer"))
        name = F.when(answer["event"] == "approve", "approved").when(answer["event"] == "deny", "denied").otherwise("signed out")
        approved = F.coalesce((F.col("current") == "approved") | (answer["event"] == "approve"), F.lit(False))
        left = F.when(approved, F.col("leave"))
        alive = left.isNull() & (approved | (waits & F.col("answer").isNull()))
        expires = F.col("started_ms") + ttl
        over = alive & (expires < F.lit(now - delay_minutes * 60_000))
        step = lambda cond, state, ms: F.when(cond, F.struct(state.alias("state"), ms.alias("at_ms")))
        steps = F.array_compact(
            F.array(
                step(F.col("_began"), F.lit("waiting"), F.col("started_ms")),
                step(answer.isNotNull(), name, answer["ms"]),
                step(left.isNotNull(), F.lit("signed out"), left["ms"]),
                step(over, F.lit("expired"), expires),
            )
        )
        out.write(rows.select("session_id", F.inline(steps)), n)
        still = rows.filter(alive & ~over).select("session_id", "started_ms", F.when(approved, "approved").otherwise("waiting").alias("current"))
        live.write(still, n)

    drain(events, run, each)
    return out.read(events.sparkSession)
