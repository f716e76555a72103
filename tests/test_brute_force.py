"""Set-at-once operators against plain loops, with one key holding a third of the rows or more."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillworks.functions import timeutil as T
from tillworks.operators import access as A
from tillworks.operators import coupons as C
from tillworks.operators import claims, kitchen, prefix, stock

BASE = datetime(2024, 1, 1)


def hot_key(rng, n):
    return 0 if rng.random() < 0.4 else rng.randrange(n)


def test_running_helpers(spark):
    rng = random.Random(1)
    rows = [(i, hot_key(rng, 5), BASE + timedelta(minutes=rng.randrange(3000)), rng.randrange(10), rng.choice([None, "a", "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, created_at timestamp_ntz, v bigint, s string")
    slot, order = T.hour_slot(F.col("created_at")), ["created_at", "id"]
    sums = {r.id: r.t for r in prefix.running_sum(df, ["k"], order, slot, t=F.col("v")).collect()}
    prev = {r.id: r.p for r in prefix.previous_value(df, ["k"], order, slot, "v", "p").collect()}
    last = {r.id: r.l for r in prefix.running_last(df, ["k"], order, slot, "s", "l").collect()}
    total, before, seen = defaultdict(int), {}, {}
    for i, k, _, v, s in sorted(rows, key=lambda r: (r[2], r[0])):
        total[k] += v
        seen[k] = s or seen.get(k)
        assert (sums[i], prev[i], last[i]) == (total[k], before.get(k), seen[k])
        before[k] = v


def test_ledger_loop(spark):
    rng = random.Random(2)
    kinds = ["purchase", "waste", "count", "sale", "sale_reversal"]
    rows = [(i, hot_key(rng, 6), rng.choice(kinds), D(rng.randrange(1, 500)) / 10, None, BASE + timedelta(minutes=rng.randrange(5000))) for i in range(800)]
    ev = spark.createDataFrame(rows, "id bigint, ingredient_id bigint, kind string, qty decimal(14,3), order_id bigint, created_at timestamp_ntz")
    opening = {k: D(100 * k) for k in range(4)}
    start = spark.createDataFrame(list(opening.items()), "id bigint, stock decimal(14,3)")
    got = {r.id: (r.qty, r.balance_after) for r in stock.stock_ledger(ev, start).collect()}
    bal = defaultdict(D, opening)
    for i, k, kind, q, _, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        new = q if kind == "count" else bal[k] + (q if kind in ("purchase", "sale_reversal") else -q)
        assert got[i] == (new - bal[k], new)
        bal[k] = new
    assert len(got) == len(rows)


def test_block_mode_loop(spark):
    rng = random.Random(3)
    orders = [(i, BASE + timedelta(minutes=rng.randrange(2000))) for i in range(150)]
    need = {(i, g): D(rng.randrange(1, 9)) for i, _ in orders for g in {hot_key(rng, 6), hot_key(rng, 6)}}
    left = {g: D(60) for g in range(6)}
    n = spark.createDataFrame([(o, g, q) for (o, g), q in need.items()], "order_id bigint, ingredient_id bigint, need decimal(14,3)")
    o = spark.createDataFrame(orders, "id bigint, created_at timestamp_ntz")
    got = {r.order_id: r.accepted for r in stock.deduct_sales_blocking(n, o, spark.createDataFrame(list(left.items()), "id bigint, stock decimal(14,3)")).collect()}
    want = {}
    for i, _ in sorted(orders, key=lambda r: (r[1], r[0])):
        mine = {g: q for (oo, g), q in need.items() if oo == i}
        want[i] = all(left[g] >= q for g, q in mine.items())
        if want[i]:
            for g, q in mine.items():
                left[g] -= q
    assert got == want and 0 < sum(want.values()) < len(want)


def replayed(asked, capacity, changes):
    """Request by request in time order; what is given back at an instant comes before its requests."""
    used, back, out = defaultdict(int), [], {}
    requests = defaultdict(list)
    for bill, at, r, need, until in asked:
        requests[at, bill].append((r, need, until))
    for at, bill in sorted(requests):
        for time, r, amount in [x for x in back + changes if x[0] <= at]:
            used[r] += amount
        back, changes = [x for x in back if x[0] > at], [x for x in changes if x[0] > at]
        bound = [x for x in requests[at, bill] if x[0] in capacity]
        ok = all(used[r] + need <= capacity[r] for r, need, _ in bound)
        if bound:
            out[bill] = (ok, {r: used[r] for r, _, _ in bound})
        for r, need, until in bound if ok else ():
            used[r] += need
            if until is not None and until > at:
                back.append((until, r, -need))
    return out


def claim_case(rng):
    hour = claims.HOUR_US
    asked = []
    for bill in range(1, 260):
        at = rng.randrange(60) * hour // 4
        for r in {f"r{hot_key(rng, 7)}", f"r{hot_key(rng, 7)}", f"r{rng.randrange(9)}"}:
            asked.append((bill, at, r, rng.randrange(1, 6), rng.choice([None, None, at + rng.randrange(0, 9) * hour])))
    capacity = {f"r{i}": rng.choice([0, 5, 20, 60]) for i in range(7)} | {"idle": 3}
    changes = [(rng.randrange(-10, 60) * hour // 4, f"r{rng.randrange(8)}", rng.choice([-3, -1, 1, 2])) for _ in range(40)]
    return asked, capacity, changes


def test_claims_loop(spark):
    """Any prefix size gives the row-by-row decisions, with uses given back and uses from elsewhere."""
    rng = random.Random(31)
    for prefix_size in (60, claims.PREFIX):
        asked, capacity, changes = claim_case(rng)
        a = spark.createDataFrame(asked, "bill bigint, at bigint, resource string, need bigint, until bigint")
        c = spark.createDataFrame(list(capacity.items()), "resource string, capacity bigint")
        h = spark.createDataFrame(changes, "time bigint, resource string, amount bigint")
        want = replayed(asked, capacity, changes)
        steps = [dict(map(tuple, r.collect())) for r in claims.rounds(a, c, h, prefix_size)]
        got = {k: v for s in steps for k, v in s.items()}
        assert got == {b: ok for b, (ok, _) in want.items()} and sum(map(len, steps)) == len(got)
        if prefix_size == claims.PREFIX:
            assert len(steps) == 1
            bound = a.join(c, "resource").select(a.columns)
            taken = bound.join(spark.createDataFrame([(b,) for b, ok in got.items() if ok], "bill bigint"), "bill", "left_semi").select(a.columns)
            before = defaultdict(dict)
            for r in claims.used_before(bound.drop("until"), taken, h).collect():
                before[r.bill][r.resource] = r.used
            assert dict(before) == {b: u for b, (_, u) in want.items()}


def test_rounds_are_bounded(spark):
    """A chain in which every decision hangs on the one before: each round still decides a whole prefix."""
    n, size = 120, 80
    asked = [(i, i, f"r{i // 2}", 1, None) for i in range(n)] + [(i, i, f"s{(i + 1) // 2}", 1, None) for i in range(n)]
    a = spark.createDataFrame(asked, "bill bigint, at bigint, resource string, need bigint, until bigint")
    c = spark.createDataFrame([(r, 1) for r in {x[2] for x in asked}], "resource string, capacity bigint")
    steps = [dict(map(tuple, r.collect())) for r in claims.rounds(a, c, prefix=size)]
    assert len(steps) <= 2 * n // size + 1
    assert {k: v for s in steps for k, v in s.items()} == {b: ok for b, (ok, _) in replayed(asked, {r: 1 for r in {x[2] for x in asked}}, []).items()}


def test_bogo_units(spark):
    rng = random.Random(4)
    lines = [(b, m, rng.randrange(1, 6)) for b in range(80) for m in rng.sample(range(20), rng.randrange(1, 8))] + [(999, m, 50) for m in range(20)]
    price = {m: D(5 + m % 7) for m in range(20)}
    levels = spark.createDataFrame([(b, price[m], True, q) for b, m, q in lines], "order_id bigint, price decimal(10,2), eligible boolean, qty int")
    levels = C.price_levels(levels)
    offers = spark.createDataFrame([(b, 2, 1) for b in {r[0] for r in lines}], "order_id bigint, buy_qty int, get_qty int")
    got = {r.order_id: r.bogo_discount for r in C.bogo_discounts(levels, offers).collect()}
    units = defaultdict(list)
    for b, m, q in lines:
        units[b] += [price[m]] * q
    for b, u in units.items():
        assert got[b] == sum(sorted(u)[: len(u) // 3], D(0))


def test_limits_loop(spark):
    rng = random.Random(5)
    menu = spark.createDataFrame([(1, "m", "A", D("10"), True)], "id bigint, name string, category string, price decimal(10,2), is_active boolean")
    coupons = [(1, "HOT", 40, 2), (2, "PER", None, 1), (3, "TOT", 25, None), (4, "PAIR", 30, 3)]
    schema = (
        "id bigint, code string, kind string, value decimal(10,2), max_discount decimal(10,2), min_bill decimal(10,2), buy_qty int, get_qty int, applies_to string, "
        "item_ids array<bigint>, categories array<string>, valid_from date, valid_to date, usage_limit int, per_customer_limit int, is_active boolean"
    )
    table = [(i, c, "bogo", D(0), None, D(0), 1, 1, "all", [], [], None, None, u, p, True) for i, c, u, p in coupons]
    rows, lines = [], []
    for i in range(500):
        phone = rng.choice([None, "p0", "p0", "p0", f"p{rng.randrange(30)}"])
        code = "HOT" if rng.random() < 0.4 else rng.choice(coupons)[1]
        rows.append((i, phone, BASE + timedelta(minutes=rng.randrange(6000)), rng.choice(["paid", "paid", "cancelled"]), code))
        lines.append((i, 1, rng.choice([1, 2, 3])))
    out = C.settlement(
        spark.createDataFrame(rows, "id bigint, phone string, created_at timestamp_ntz, payment_status string, code string"),
        spark.createDataFrame(lines, "order_id bigint, menu_item_id bigint, qty int"), spark.createDataFrame(table, schema), menu,
    )
    got = {r.id: r.reason for r in out.collect()}
    limits, qty = {c: (u, p) for _, c, u, p in coupons}, {b: q for b, _, q in lines}
    used, mine = defaultdict(int), defaultdict(int)
    for i, phone, _, status, code in sorted(rows, key=lambda r: (r[2], r[0])):
        total, per = limits[code]
        if total is not None and used[code] >= total:
            want = "used up"
        elif per is not None and phone is None:
            want = "needs phone"
        elif per is not None and mine[code, phone] >= per:
            want = "customer limit"
        elif qty[i] < 2:
            want = "too few items"
        else:
            want = None
            if status != "cancelled":
                used[code] += 1
                mine[code, phone] += 1
        assert got[i] == want, (i, got[i], want)


COUPON = (
    "id bigint, code string, kind string, value decimal(10,2), max_discount decimal(10,2), min_bill decimal(10,2), buy_qty int, get_qty int, applies_to string, "
    "item_ids array<bigint>, categories array<string>, valid_from date, valid_to date, usage_limit int, per_customer_limit int, is_active boolean"
)
BILL = "id bigint, phone string, created_at timestamp_ntz, payment_status string, code string"
STORED = "id bigint, coupon_id bigint, phone string, created_at timestamp_ntz"
CANCEL = "id bigint, at timestamp_ntz"


def test_limits_over_stored_bills_loop(spark):
    """Stored uses and cancellations run with the batch; two batches give what one gives."""
    rng = random.Random(15)
    at = lambda: BASE + timedelta(minutes=rng.randrange(4000))
    limits = {"HOT": (12, 2), "PER": (None, 1), "TOT": (9, None)}
    coupons = spark.createDataFrame([(i, c, "flat", D(1), None, D(0), None, None, "all", [], [], None, None, u, p, True) for i, (c, (u, p)) in enumerate(limits.items(), 1)], COUPON)
    menu = spark.createDataFrame([(1, "m", "A", D("10"), True)], "id bigint, name string, category string, price decimal(10,2), is_active boolean")
    phone = lambda: rng.choice([None, "p0", "p0", f"p{rng.randrange(12)}"])
    bills = [(i, phone(), at(), "paid", "HOT" if rng.random() < 0.4 else rng.choice(list(limits))) for i in range(1, 241)]
    stored = [(-i, rng.choice([1, 1, 2, 3]), phone(), at()) for i in range(1, 40)]
    when = {r[0]: r[2] for r in bills} | {r[0]: r[3] for r in stored}
    cancels = [(i, when[i] + timedelta(minutes=rng.randrange(1, 900))) for i in rng.sample(sorted(when), 130)]
    gone = dict(cancels)
    ids = {c: i for i, c in enumerate(limits, 1)}
    held, want = [(c, p, t, gone.get(i)) for i, c, p, t in stored], {}
    for i, p, t, _, code in sorted(bills, key=lambda r: (r[2], r[0])):
        live = [h for h in held if h[0] == ids[code] and h[2] <= t and (h[3] is None or h[3] > t)]
        total, per = limits[code]
        if total is not None and len(live) >= total:
            want[i] = "used up"
        elif per is not None and p is None:
            want[i] = "needs phone"
        elif per is not None and sum(h[1] == p for h in live) >= per:
            want[i] = "customer limit"
        else:
            want[i] = None
            held.append((ids[code], p, t, gone.get(i)))
    lines = spark.createDataFrame([(r[0], 1, 1) for r in bills], "order_id bigint, menu_item_id bigint, qty int")
    cancelled = spark.createDataFrame(cancels, CANCEL)
    run = lambda rows, past: {r.id: r.reason for r in C.settlement_over_time(spark.createDataFrame(rows, BILL), lines, coupons, menu, spark.createDataFrame(past, STORED), cancelled).collect()}
    assert run(bills, stored) == want and set(want.values()) == {None, "used up", "needs phone", "customer limit"}
    # A bill that a limit would refuse for good is taken once a cancellation has freed a use.
    assert any(want[i] is None and sum(h[0] == ids[c] and h[2] < t for h in held) >= limits[c][0] for i, _, t, _, c in bills if limits[c][0])
    bills.sort(key=lambda r: (r[2], r[0]))
    first = run(bills[:130], stored)
    taken = [(i, ids[c], p, t) for i, p, t, _, c in bills[:130] if first[i] is None]
    assert first | run(bills[130:], stored + taken) == want


def test_failures_loop(spark):
    rng = random.Random(6)
    rows = [(i, f"u{hot_key(rng, 5)}", rng.choice([None, "ip0", "ip0", f"ip{rng.randrange(6)}"]), rng.random() < 0.2, BASE + timedelta(seconds=rng.randrange(7200))) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz")
    got = {r.id: r for r in A.lockouts(df).collect()}
    quarter = timedelta(minutes=15)
    for i, u, ip, _, at in rows:
        ok = [r[4] for r in rows if r[1] == u and r[3] and r[4] < at]
        since = max([at - quarter] + ok)
        mine = sorted((r[4] for r in rows if r[1] == u and not r[3] and since < r[4] < at), reverse=True)
        near = sum(1 for r in rows if ip and r[2] == ip and not r[3] and at - quarter < r[4] < at)
        assert (got[i].user_failures, got[i].ip_failures) == (len(mine), near)
        want = None if len(mine) < 5 else max(-(-((mine[4] + quarter - at).total_seconds()) // 60), 1)
        assert got[i].wait_minutes == want


def test_failures_of_one_user(spark):
    """All tries on one user and one address within two quarter hours: no window holds the whole key."""
    rng = random.Random(61)
    rows = [(i, "u", "a", rng.random() < 0.01, BASE + timedelta(seconds=rng.randrange(1800), microseconds=rng.choice([0, 1]))) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz")
    seen = {r.id: (r.user_failures, r.ip_failures) for r in A.failures_in_window(df).collect()}
    quarter = timedelta(minutes=15)
    for i, _, _, _, at in rows:
        since = max([at - quarter] + [r[4] for r in rows if r[3] and r[4] < at])
        near = [r[4] for r in rows if not r[3] and at - quarter < r[4] < at]
        assert seen[i] == (sum(t > since for t in near), len(near))
    lone = spark.createDataFrame([(1, None, None, False, BASE), (2, "u", None, False, BASE), (3, "u", "a", False, BASE)], df.schema)
    assert sorted(tuple(r)[5:] for r in A.failures_in_window(lone).collect()) == [(0, None, 0)] * 3
    assert A.failures_in_window(df.limit(0)).count() == 0


def test_session_gate_loop(spark):
    """Overlapping sessions of one busy account; starts, answers and ends at the very instant of an event."""
    rng = random.Random(62)
    at = lambda n: BASE + timedelta(minutes=5 * rng.randrange(n))
    admins = [(0, "u0", "super", True), (1, "u1", "admin", True), (2, "u2", "admin", True), (3, "u3", "admin", False)]
    sessions = []
    for i in range(60):
        start = at(900)
        ok = rng.choice([None, start, start + timedelta(minutes=5 * rng.randrange(200))])
        sessions.append((i, 1 if rng.random() < 0.6 else rng.randrange(5), start, ok, start + timedelta(hours=rng.choice([0, 2, 12]))))
    events = [(i, f"u{1 if rng.random() < 0.6 else rng.randrange(5)}", at(1100)) for i in range(400)] + [(400, None, BASE)]
    who = spark.createDataFrame(admins, "id bigint, username string, role string, is_active boolean")
    who = who.withColumns({c: F.lit(None).cast("string") for c in ("login_from", "login_to")})
    ev = spark.createDataFrame(events, "id bigint, username string, created_at timestamp_ntz")
    se = spark.createDataFrame(sessions, "id bigint, admin_id bigint, created_at timestamp_ntz, approved_at timestamp_ntz, expires_at timestamp_ntz")
    got = {r.id: r.verdict for r in A.session_gate(ev, se, who).collect()}
    names = {u: (k, role) for k, u, role, active in admins if active}
    for i, u, t in events:
        k, role = names.get(u, (None, None))
        live = [s for s in sessions if s[1] == k and s[2] <= t < s[4]]
        ok = role == "super" or any(s[3] is not None and s[3] <= t for s in live)
        assert got[i] == ("expired" if not live else "ok" if ok else "waiting")
    assert len(got) == len(events) and set(got.values()) == {"expired", "ok", "waiting"}


def test_payment_fold_loop(spark):
    rng = random.Random(7)
    rows = [(i, hot_key(rng, 20), rng.choice(["paid", "pending", "cancelled"]), BASE + timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, order_id bigint, payment_status string, created_at timestamp_ntz")
    got = {r.order_id: (r.payment_status, r.paid_at) for r in kitchen.payment_fold(df).collect()}
    state = {}
    for _, o, s, at in rows:
        paid = state.get(o, (None, None))[1]
        state[o] = (s, (paid or at) if s == "paid" else None if s == "pending" else paid)
    assert got == state


def test_restore_nets_to_zero(spark):
    need = spark.createDataFrame([(1, 1, D("3")), (1, 2, D("4"))], "order_id bigint, ingredient_id bigint, need decimal(14,3)")
    changes = spark.createDataFrame([(1, "paid", "cancelled", BASE)], "order_id bigint, old string, new string, created_at timestamp_ntz")
    back = stock.status_moves(changes, need).select("order_id", "ingredient_id", "qty")
    sold = need.select("order_id", "ingredient_id", (-F.col("need")).alias("qty"))
    assert stock.net_movements(sold.unionByName(back)).count() == 0
