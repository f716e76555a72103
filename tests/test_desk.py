"""Requests at the desk against plain loops, with one key holding a third of the rows or more."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillworks.functions import messages
from tillworks.functions import timeutil as T
from tillworks.operators import diff, maintain, payments, prefix, shifts, stock

BASE = datetime(2024, 1, 1)


def hot_key(rng, n):
    return 0 if rng.random() < 0.4 else rng.randrange(n)


def minute(rng, n):
    return BASE + timedelta(minutes=rng.randrange(n))


def test_latest_before(spark):
    rng = random.Random(1)
    rows = [(i, hot_key(rng, 5), minute(rng, 3000), rng.choice([None, None, "a", "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, created_at timestamp_ntz, s string")
    got = prefix.latest_before(df, ["k"], ["created_at", "id"], T.hour_slot(F.col("created_at")), m=F.col("s"), n=F.when(F.col("s") == "b", F.col("id")))
    got = {r.id: (r.m, r.n) for r in got.collect()}
    seen, last_b = {}, {}
    for i, k, _, s in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == (seen.get(k), last_b.get(k))
        seen[k] = s or seen.get(k)
        if s == "b":
            last_b[k] = i


def loop_payments(orders, requests):
    state = {o[0]: [o[1], o[2], o[4]] for o in orders}
    total = {o[0]: o[3] for o in orders}
    out = {}
    for i, o, kind, value, at in sorted(requests, key=lambda r: (r[4], r[0])):
        method = (value or "").strip().lower() or None
        if kind == "pay" and method not in (None, "cash", "upi", "card"):
            out[i] = (None, None, messages.BAD_METHOD, None)
        elif kind != "pay" and value not in payments.STATUSES:
            out[i] = (None, None, messages.BAD_STATUS, None)
        elif o not in state:
            out[i] = (None, None, messages.NO_ORDER, None)
        else:
            s = state[o]
            old = s[0]
            if kind == "pay" and old == "cancelled":
                out[i] = (old, None, messages.NOT_PENDING, None)
                continue
            note = None
            if kind == "pay" and old == "pending":
                s[:] = ["paid", method or s[1], at]
                note = json.loads(json.dumps({"method": s[1], "total": float(total[o])}))
            elif kind != "pay" and old != value:
                s[0] = value
                s[2] = (s[2] or at) if value == "paid" else None if value == "pending" else s[2]
                note = {"from": old, "to": value}
            out[i] = (old, s[0], None, note)
    return state, out


def test_payments_loop(spark):
    rng = random.Random(2)
    status = lambda: rng.choice(payments.STATUSES)
    orders = []
    for i in range(12):
        s = status()
        orders.append((i, s, rng.choice([None, "cash", "card"]), D(i) + D("0.50"), rng.choice([None, BASE]) if i % 3 else (BASE if s == "paid" else None)))
    requests = []
    for i in range(700):
        kind = rng.choice(["pay", "status"])
        value = rng.choice([None, "", " UPI ", "card", "cheque"]) if kind == "pay" else rng.choice([*payments.STATUSES, *payments.STATUSES, None, "Paid"])
        requests.append((i, hot_key(rng, 14), kind, value, minute(rng, 4000)))
    o = spark.createDataFrame(orders, "id bigint, payment_status string, payment_method string, total decimal(10,2), paid_at timestamp_ntz")
    r = spark.createDataFrame(requests, "id bigint, order_id bigint, kind string, value string, created_at timestamp_ntz")
    decided = payments.decide(r, o)
    state, want = loop_payments(orders, requests)
    details = {x.id: json.loads(x.details) for x in payments.audit(decided).collect()}
    got = {x.id: (x.old, x.new, x.error, details.get(x.id)) for x in decided.collect()}
    assert got == want
    assert {x.id: [x.payment_status, x.payment_method, x.paid_at] for x in payments.orders_after(o, decided).collect()} == state
    assert payments.decide(r.limit(0), o).count() == 0 and payments.orders_after(o, decided.limit(0)).count() == len(orders)


def test_stock_inputs_loop(spark):
    rng = random.Random(3)
    amount = lambda: rng.choice([None, D(0), D(-1), *[D(rng.randrange(1, 900)) / 10] * 6, D(2_000_000_000)])
    rows = [(i, hot_key(rng, 7), rng.choice(["purchase", "waste", "count", "sale", None]), amount(), rng.choice([None, "  ", " ok ", "x" * 201]), minute(rng, 4000)) for i in range(700)]
    parts = [(i, f"Part {i}", "g", i % 2 == 0, D(10 * i)) for i in range(5)]
    inputs = spark.createDataFrame(rows, "id bigint, ingredient_id bigint, kind string, qty decimal(14,3), note string, created_at timestamp_ntz")
    ingredients = spark.createDataFrame(parts, "id bigint, name string, unit string, track_stock boolean, stock decimal(14,3)")
    done = stock.stock_inputs(inputs, ingredients)
    got = {r.id: (r.error, r.before, r.after) for r in done.collect()}
    left, tracked = {p[0]: p[4] for p in parts}, {p[0]: p[3] for p in parts}
    for i, g, kind, q, note, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        if kind not in ("purchase", "waste", "count"):
            error = messages.BAD_STOCK_KIND
        elif q is None or q > 10**9 or q < 0 or (q == 0 and kind != "count"):
            error = messages.BAD_COUNT if kind == "count" else messages.BAD_QUANTITY
        elif note and len(note.strip()) > 200:
            error = messages.LONG_NOTE
        else:
            error = None if g in left else messages.NO_INGREDIENT
        if error:
            assert got[i] == (error, None, None)
            continue
        new = q if kind == "count" else left[g] + (q if kind == "purchase" else -q)
        assert got[i] == (None, left[g], new)
        left[g], tracked[g] = new, True
    assert len(got) == len(rows)
    assert {r.id: (r.stock, r.track_stock) for r in stock.ingredients_after(ingredients, done).collect()} == {g: (left[g], tracked[g]) for g in left}
    assert stock.input_audit(done).count() == sum(e is None for e, _, _ in got.values())


def test_shift_turns_loop(spark):
    rng = random.Random(4)
    people = [(i, f"staff{i}", "super" if i == 4 else "admin") for i in range(5)]
    stored = [(-1, 0, BASE - timedelta(days=2), None, None, D(100), None), (-2, 1, BASE - timedelta(days=3), BASE - timedelta(days=2), 1, D(50), D(60))]
    requests = []
    for i in range(500):
        kind = rng.choice(["open", "close"])
        target = rng.choice([None, None, rng.randrange(-3, 500), max(0, i - rng.randrange(40))]) if kind == "close" else None
        requests.append((i, hot_key(rng, 5), kind, rng.choice([None, D(-1), *[D(rng.randrange(500))] * 5]), rng.choice([None, " n ", *["x" * 201] * (rng.random() < 0.2)]), target, minute(rng, 6000)))
    bills = [(i, hot_key(rng, 5), D(rng.randrange(1, 100)), rng.choice(["paid", "pending", "cancelled"]), rng.choice(["cash", "upi", "card"]), minute(rng, 6000)) for i in range(400)]
    admins = spark.createDataFrame(people, "id bigint, username string, role string")
    there = spark.createDataFrame(stored, "id bigint, admin_id bigint, opened_at timestamp_ntz, closed_at timestamp_ntz, closed_by bigint, opening_cash decimal(10,2), counted_cash decimal(10,2)")
    asked = spark.createDataFrame(requests, "id bigint, admin_id bigint, kind string, cash decimal(12,2), note string, target bigint, created_at timestamp_ntz")
    orders = spark.createDataFrame(bills, "id bigint, created_by bigint, total decimal(10,2), payment_status string, payment_method string, created_at timestamp_ntz")
    decided = shifts.decide_turns(asked, admins, there)
    got = {r.id: (r.shift_id, r.error) for r in decided.collect()}

    known = {s[0]: [s[1], s[2], s[3], s[5]] for s in stored}
    current = {0: -1}
    want, closed = {}, {}
    for i, who, kind, cash, note, target, at in sorted(requests, key=lambda r: (r[6], r[0])):
        bad = cash is None or cash < 0
        if kind == "open":
            if bad:
                want[i] = (None, messages.BAD_OPENING_CASH)
            elif who in current:
                want[i] = (None, messages.OPEN_ALREADY)
            else:
                current[who], known[i], want[i] = i, [who, at, None, cash], (i, None)
            continue
        shift = current.get(who) if target is None else target if target in known else None
        if shift is None:
            want[i] = (None, messages.NONE_OPEN if target is None else messages.NO_SHIFT)
        elif known[shift][0] != who and who != 4:
            want[i] = (None, messages.SUPER_ONLY)
        elif known[shift][2] is not None:
            want[i] = (None, messages.SHIFT_CLOSED)
        elif bad or (note and len(note.strip()) > 200):
            want[i] = (None, messages.BAD_COUNTED_CASH if bad else messages.LONG_NOTE)
        else:
            owner, opened, _, opening = known[shift]
            known[shift][2] = at
            del current[owner]
            drawer = sum((b[2] for b in bills if b[1] == owner and opened <= b[5] < at and b[3] == "paid" and b[4] == "cash"), D(0))
            closed[shift] = (at, who, cash, opening + drawer, cash - opening - drawer)
            want[i] = (shift, None)
    assert got == want
    after = shifts.shifts_after(decided, there, orders)
    rows = {r.id: r for r in after.collect()}
    assert set(rows) == set(known) and len(closed) > 10
    for s, (at, who, cash, expected, off) in closed.items():
        r = rows[s]
        assert (r.closed_at, r.closed_by, r.counted_cash, r.expected_cash, r.difference) == (at, who, cash, expected, off)
        assert D(str(json.loads(r.totals)["cash"])) == expected - known[s][3]
    assert all(r.totals is None for s, r in rows.items() if s not in closed)
    notes = shifts.turn_audit(decided, after, admins).collect()
    assert len(notes) == sum(e is None for _, e in want.values()) and all(json.loads(n.details)["username"] for n in notes)
    assert shifts.decide_turns(asked.limit(0), admins, there).count() == 0


def test_rekey_keeps_numbers_apart(spark):
    people = spark.createDataFrame([(f"900000000{i}", f"n{i}") for i in range(6)], "phone string, name string")
    wanted = [("9000000000", "8000000000"), ("9000000001", "8000000000"), ("9000000002", "9000000003"), ("9000000004", "12"), ("9000000005", "8000000005"), ("7000000000", "8000000009")]
    moved, made = maintain.rekey_customers(people, spark.createDataFrame(wanted, "phone string, new_phone string"))
    assert {(r.phone, r.new_phone) for r in made.collect()} == {("9000000000", "8000000000"), ("9000000005", "8000000005")}
    phones = [r.phone for r in moved.collect()]
    assert len(phones) == len(set(phones)) == 6 and "8000000005" in phones and "9000000005" not in phones


def test_audit_texts_of_odd_documents(spark):
    rows = [("order.delete", "{}"), ("menu.recipe", "{}"), ("menu.delete", '{"name":"x"}'), ("shift.close", "{}"), ("staff.update", '{"username":"a","changes":{}}'), ("stock.count", "not json"), ("unknown.kind", None)]
    audit = spark.createDataFrame([(a, "7", d) for a, d in rows], "action string, entity_id string, details string")
    got = {r.action: r.summary for r in diff.render(audit, "₹").collect()}
    assert set(got) == {a for a, _ in rows} and got["menu.recipe"] == "Before: none; After: none"
