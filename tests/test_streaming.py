"""Streams fed in several micro-batches give the rows of their batch twins."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillworks.catalog.params import AS_OF, EVENTS_AS_OF
from tillworks.operators import access as A
from tillworks.operators import groups
from tillworks.operators import kitchen as K
from tillworks.operators import shifts as H
from tillworks.operators import signin
from tillworks.operators import stock as S
from tillworks.operators.groups import linked
from tillworks.sources.adapters import Tables
from tillworks.sources.schemas import RAW
from tillworks.streaming import guard, jobs, stateful
from tillworks.streaming.feeds import drain_to_parquet, stream_raw
from tillworks.streaming.state import BatchLog, DayLog

BASE = datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def sliced(spark, folder, run_dir):
    """Events and orders cut into four time slices, read one file per micro-batch."""

    class Sliced(Tables):
        def raw(self, name):
            return spark.readStream.schema(RAW[name]).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/{name}")

    full = Tables(spark, folder)
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        df = full.raw(name).withColumn("_s", F.col(key) % 4 if name == "orders" else F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("ts")) - 1)
        for i in range(4):
            df.filter(F.col("_s") == i).drop("_s").coalesce(1).write.mode("append").parquet(f"{run_dir}/{name}")
    return Sliced(spark, run_dir), full


def test_stock(sliced, run_dir):
    live, full = sliced
    want = S.stock_ledger(full.stock_events, full.ingredients)
    got = jobs.stock(live.stock_events, full.ingredients, f"{run_dir}/job")
    assert rows(got) == rows(want.select(got.columns))
    assert jobs.low_stock_crossings(got, full.ingredients).count() == jobs.low_stock_crossings(want, full.ingredients).count()


def test_boards_and_totals(sliced, run_dir):
    live, full = sliced
    board = jobs.kitchen_board(live.orders, f"{run_dir}/board", AS_OF)
    assert rows(board, "id", "board") == rows(K.kitchen_queue(full.orders, AS_OF), "id", "board")
    totals = jobs.shift_totals(live.orders, full.shifts, f"{run_dir}/totals", AS_OF)
    assert rows(totals) == rows(H.shift_totals(H.shift_orders(full.shifts, full.orders, AS_OF)).select(totals.columns))
    sales = jobs.sales_day_hour(live.orders, f"{run_dir}/sales")
    paid = full.orders.filter("payment_status = 'paid'")
    assert sales.filter("grain = 'hour'").agg(F.sum("orders")).first()[0] == paid.count()
    assert sales.filter("grain = 'day'").agg(F.sum("total")).first()[0] == paid.agg(F.sum("total")).first()[0]


def test_alerts(sliced, run_dir):
    live, full = sliced
    got = jobs.login_alerts(live.logins, full.admins, f"{run_dir}/alerts", EVENTS_AS_OF, "staff10")
    assert got.filter("username = 'staff10'").count() == 0
    cutoff = EVENTS_AS_OF - timedelta(hours=1)
    want = full.logins.filter(F.col("succeeded") & (F.col("username") != "staff10") & (F.col("created_at") > F.lit(str(cutoff)).cast("timestamp_ntz")))
    assert rows(got, "id") == rows(want, "id")


def test_new_orders_once(spark, run_dir):
    for _ in range(2):
        spark.createDataFrame([(1, BASE), (2, BASE + timedelta(minutes=1))], "id bigint, created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema("id bigint, created_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    assert rows(jobs.new_orders(stream, f"{run_dir}/out"), "id") == [(1,), (2,)]


def test_folder_table_in_no_order(spark, folder, run_dir):
    """Part files in no time order, one a micro-batch: no row is lost, the board follows event time."""

    class Live(Tables):
        def raw(self, name):
            return stream_raw(spark, run_dir, name, 1)

    full = Tables(spark, folder)
    full.raw("orders").repartition(4).write.parquet(f"{run_dir}/orders.parquet")
    full.raw("orders").limit(3).write.parquet(f"{run_dir}/orders_old.parquet")
    live = Live(spark, run_dir)
    new = jobs.new_orders(live.orders, f"{run_dir}/new")
    assert rows(new, "id", "created_at") == rows(full.orders, "id", "created_at")
    board = jobs.kitchen_board(live.orders, f"{run_dir}/board", AS_OF)
    assert rows(board, "id", "board") == rows(K.kitchen_queue(full.orders, AS_OF), "id", "board")


def test_one_file_table(spark, folder):
    assert stream_raw(spark, folder, "orders").isStreaming
    assert BatchLog(f"{folder}/no-such-table", "id bigint").read(spark).count() == 0


def test_board_keeps_cancelled(spark, run_dir):
    """A late older row neither changes a newer status nor brings a cancelled order back."""
    at = lambda m: AS_OF - timedelta(minutes=m)
    schema = "id bigint, customer_name string, payment_status string, kitchen_status string, kitchen_updated_at timestamp_ntz, created_at timestamp_ntz"
    batches = [[(1, "a", "cancelled", "preparing", at(5), at(60)), (2, "b", "paid", "ready", at(5), at(60))], [(1, "a", "paid", "preparing", at(50), at(60)), (2, "b", "paid", "preparing", at(50), at(60))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = jobs.kitchen_board(stream, f"{run_dir}/out", AS_OF)
    assert rows(got, "id", "kitchen_status") == [(2, "ready")]


def test_lockout_loop(spark, run_dir):
    """Raw tries: refused ones leave no trace."""
    import random

    rng = random.Random(9)
    data = sorted(((BASE + timedelta(seconds=rng.randrange(5000)), rng.choice(["a", "a", "b"]), rng.random() < 0.05) for _ in range(300)))
    tries = [(i, u, "ip", ok, at) for i, (at, u, ok) in enumerate(data)]
    schema = "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz"
    for part in (tries[:100], tries[100:200], tries[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = {r.id: (r.allowed, r.wait_minutes) for r in drain_to_parquet(stateful.attempt_lockout(stream, "username", 5, True), f"{run_dir}/out").collect()}
    recorded, want = [], {}
    quarter = timedelta(minutes=15)
    for i, u, _, ok, at in tries:
        last_ok = max([r[1] for r in recorded if r[0] == u and r[2]], default=BASE - timedelta(days=1))
        fails = [r[1] for r in recorded if r[0] == u and not r[2] and r[1] > max(last_ok, at - quarter)]
        # A success at the very instant of a failure sorts by id, as in the table.
        if len(fails) >= 5:
            want[i] = (False, max(-(-int((fails[-5] + quarter - at).total_seconds()) // 60), 1))
        else:
            want[i] = (True, None)
            recorded.append((u, at, ok))
    assert got == want and any(not a for a, _ in got.values())


def guarded(tries):
    """Try by try: id to (lock, wait in minutes)."""
    recorded, out, quarter = [], {}, timedelta(minutes=15)
    for i, user, ip, ok, at in sorted(tries, key=lambda r: (r[4], r[0])):
        last_ok = max([r[4] for r in recorded if r[1] == user and r[3]], default=BASE - timedelta(days=1))
        mine = [r[4] for r in recorded if r[1] == user and not r[3] and r[4] > max(last_ok, at - quarter)]
        near = [r for r in recorded if ip is not None and r[2] == ip and not r[3] and r[4] > at - quarter]
        if len(mine) >= 5:
            out[i] = ("user", max(-(-int((mine[-5] + quarter - at).total_seconds()) // 60), 1))
        elif len(near) >= 20:
            out[i] = ("ip", None)
        else:
            out[i] = (None, None)
            recorded.append((i, user, ip, ok, at))
    return out


def attack(rng, n, seconds):
    """Few addresses against many users, one of each holding a third of the tries; instants repeat."""
    pick = lambda name, k: f"{name}0" if rng.random() < 0.35 else f"{name}{rng.randrange(k)}"
    times = sorted(BASE + timedelta(seconds=rng.randrange(seconds)) for _ in range(n))
    return [(i, pick("u", 14), rng.choice([None, pick("a", 3), pick("a", 3), pick("a", 3)]), rng.random() < 0.06, at) for i, at in enumerate(times)]


TRY = "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz"


def test_both_rules_in_one_stream(spark, run_dir):
    """User and address rule meet: what one refuses the other has not seen, in one batch or in several."""
    import random

    tries = attack(random.Random(21), 900, 6000)
    want = guarded(tries)
    assert {lock for lock, _ in want.values()} == {None, "user", "ip"}
    whole = signin.decide_tries(spark.createDataFrame(tries, TRY).repartition(4))
    assert {r.id: (r.lock, r.wait_minutes) for r in whole.collect()} == want
    for part in (tries[:250], tries[250:600], tries[600:]):
        spark.createDataFrame(part, TRY).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(TRY).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = guard.guard(stream, f"{run_dir}/out")
    assert {r.id: (r.lock, r.wait_minutes) for r in got.collect()} == want
    # The state holds at most five failures and one success of a user for each address they came from.
    held = spark.read.parquet(f"{run_dir}/out/state/version=2")
    assert held.groupBy("username", "succeeded").count().agg(F.max("count")).first()[0] <= 5


def decided_with(spark, tries):
    return {r.id: (r.lock, r.wait_minutes) for r in signin.decide_tries(spark.createDataFrame(tries, TRY).repartition(4)).collect()}


def test_locks_that_undo_each_other_cost_no_turns(spark, monkeypatch):
    """The same few tables are written however long an attack goes on."""
    import random

    written = []
    for module in (signin, groups):
        monkeypatch.setattr(module, "stage_table", lambda df, write=module.stage_table: written.append(df) or write(df))
    for n in (400, 2400):
        written.clear()
        tries = attack(random.Random(5), n, 10 * n)
        got = decided_with(spark, tries)
        assert got == guarded(tries) and {lock for lock, _ in got.values()} == {None, "user", "ip"}
        assert len(written) <= 8


def test_groups_are_replayed_apart(spark, monkeypatch):
    """Many keys of which few can lock, some bound to each other for a while only, and keys forgotten on the way."""
    import random

    monkeypatch.setattr(signin, "KEYS_KEPT", 2)
    rng, tries = random.Random(3), []
    for k in range(60):
        start = BASE + timedelta(minutes=rng.randrange(600))
        for _ in range(rng.choice([2, 4, 30, 90])):
            who, where = rng.choice([f"u{k}", f"u{k % 7}", f"v{rng.randrange(300)}", f"v{rng.randrange(300)}"]), rng.choice([f"a{k}", f"a{k}", f"a{k}", f"a{k % 5}", None])
            tries.append((len(tries), who, where, rng.random() < 0.05, start + timedelta(seconds=rng.randrange(1500))))
    got = decided_with(spark, tries)
    assert got == guarded(tries) and {lock for lock, _ in got.values()} == {None, "user", "ip"}


def test_linked_groups(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (70, 70), (-5, 60)]
    got = dict(map(tuple, linked(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90, -5: -5, 60: -5}
    assert linked(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tries_that_share_an_id(spark, run_dir):
    """Each row is a try of its own, in one batch or in several."""
    import random

    rng = random.Random(8)
    times = [BASE + timedelta(seconds=s) for s in sorted(rng.sample(range(5000), 500))]
    tries = [(i, rng.choice("stuvwxyz"), rng.choice("ab"), rng.random() < 0.3, at) for i, at in enumerate(times)]
    want = sorted((i % 40, at, *said) for (i, *_, at), said in zip(tries, guarded(tries).values()))
    for part in (tries[:200], tries[200:]):
        spark.createDataFrame([(r[0] % 40, *r[1:]) for r in part], TRY).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(TRY).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = guard.guard(stream, f"{run_dir}/out").select("id", "created_at", "lock", "wait_minutes").collect()
    assert sorted(map(tuple, got)) == want and {r[2] for r in want} == {None, "user", "ip"}


def test_guard_of_nothing(spark):
    assert signin.decide_tries(spark.createDataFrame([], TRY)).count() == 0
    lone = [(1, None, None, False, BASE), (2, "u", None, False, BASE), (3, None, "a", True, BASE)]
    assert signin.decide_tries(spark.createDataFrame(lone, TRY)).filter("lock is not null").count() == 0


def test_sales_take_back_cancelled_bills(spark, run_dir):
    """Late cancellations, repeats, reopened and corrected bills in any order: the sums of the latest versions."""
    import random
    from collections import defaultdict
    from decimal import Decimal as D

    rng = random.Random(31)
    made = {i: BASE + timedelta(minutes=rng.randrange(6000)) for i in range(60)}
    versions = []
    for i, at in made.items():
        status, t = "pending", at
        for _ in range(rng.randrange(1, 5)):
            versions.append((i, D(rng.randrange(1, 900)) / 4, status, t, at))
            status, t = rng.choice(["paid", "paid", "cancelled", "pending"]), t + timedelta(minutes=rng.randrange(1, 3000))
    last = {v[0]: v for v in sorted(versions, key=lambda v: v[3])}
    want = defaultdict(lambda: [0, D(0)])
    for _, total, status, _, at in last.values():
        if status == "paid":
            half = at - timedelta(minutes=30)
            want[half.replace(minute=0) + timedelta(minutes=30)][0] += 1
            want[half.replace(minute=0) + timedelta(minutes=30)][1] += total
    rng.shuffle(versions)
    schema = "id bigint, total decimal(14,2), payment_status string, kitchen_updated_at timestamp_ntz, created_at timestamp_ntz"
    for part in (versions[:50], versions[50:90] + versions[:10], versions[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = jobs.sales_day_hour(stream, f"{run_dir}/out")
    assert {r.start: [r.orders, r.total] for r in got.filter("grain = 'hour'").collect()} == want
    assert got.filter("grain = 'day'").agg(F.sum("orders"), F.sum("total")).first() == (sum(n for n, _ in want.values()), sum(t for _, t in want.values()))
    # Of a bill paid and then cancelled both changes are in the log, and they cancel out.
    back = spark.read.parquet(f"{run_dir}/out/changes").groupBy("id").agg(F.sum("orders").alias("n"), F.min("orders").alias("least"))
    assert {r.id: r.n for r in back.collect()} == {i: int(v[2] == "paid") for i, v in last.items()} and back.filter("least < 0").count() > 0


def test_a_batch_reads_its_own_days(spark, run_dir):
    log = DayLog(f"{run_dir}/log", "id bigint, day date")
    log.write(spark.range(4).selectExpr("id", "date_add(date'2024-01-30', int(id)) AS day"), 0)
    log.write(spark.range(0).selectExpr("id", "date'2024-01-01' AS day"), 1)
    asked = spark.sql("SELECT date'2024-01-31' AS day UNION ALL SELECT date'2024-01-09'")
    found = log.before(spark, 2, asked)
    assert [r.id for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*month", plan) and re.search(r"PushedFilters: \[[^]]*day", plan)
    assert log.before(spark, 0, asked).count() == 0 and log.read(spark).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        log.before(spark, 3, asked).count()


def test_late_orders(spark, run_dir):
    at = lambda m: BASE + timedelta(minutes=m)
    batches = [[(1, at(0), "new", "paid", at(0)), (2, at(0), "new", "paid", at(1))], [(2, at(0), "served", "paid", at(10)), (3, at(16), "new", "paid", at(16))], [(4, at(40), "new", "paid", at(40))]]
    schema = "order_id bigint, created_at timestamp_ntz, kitchen_status string, payment_status string, ts timestamp_ntz"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = rows(jobs.late_orders(stream, f"{run_dir}/out"))
    assert got == [(1, "late"), (1, "very-late"), (3, "late")]


def test_pending_logins(spark, run_dir):
    at = lambda h: BASE + timedelta(hours=h)
    batches = [[(1, "login", at(0)), (2, "login", at(0)), (3, "login", at(1))], [(1, "approve", at(1)), (2, "deny", at(2))], [(1, "logout", at(3)), (4, "login", at(30))]]
    for b in batches:
        spark.createDataFrame(b, "session_id bigint, event string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema("session_id bigint, event string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = rows(jobs.pending_logins(stream, f"{run_dir}/out"), "session_id", "state")
    assert got == [(1, "approved"), (1, "signed out"), (1, "waiting"), (2, "denied"), (2, "waiting"), (3, "expired"), (3, "waiting"), (4, "waiting")]


def test_early_answer_waits(spark, run_dir):
    at = lambda h: BASE + timedelta(hours=h)
    for b in ([(1, "approve", at(1)), (2, "login", at(1))], [(1, "login", at(0))]):
        spark.createDataFrame(b, "session_id bigint, event string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{run_dir}/in")
    stream = spark.readStream.schema("session_id bigint, event string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/in")
    got = rows(jobs.pending_logins(stream, f"{run_dir}/out"), "session_id", "state")
    assert got == [(1, "approved"), (1, "waiting"), (2, "waiting")]


def test_batch_replay_is_idempotent(spark, run_dir):
    log = BatchLog(f"{run_dir}/log", "id bigint")
    for _ in range(2):
        log.write(spark.range(3), 0)
    assert log.read(spark).count() == 3
