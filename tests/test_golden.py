"""Worked examples."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillworks.functions import access, clean, hours, labels
from tillworks.functions import timeutil as T
from tillworks.operators import coupons as C
from tillworks.operators import diff, shifts, stock
from tillworks.operators import access as A
from tillworks.plans import bills, reports

MENU = "id bigint, name string, category string, price decimal(10,2), is_active boolean"
LINES = "order_id bigint, menu_item_id bigint, qty int"
BILLS = "id bigint, phone string, created_at timestamp_ntz, payment_status string, code string"
COUPON = (
    "id bigint, code string, kind string, value decimal(10,2), max_discount decimal(10,2), min_bill decimal(10,2), buy_qty int, get_qty int, applies_to string, "
    "item_ids array<bigint>, categories array<string>, valid_from date, valid_to date, usage_limit int, per_customer_limit int, is_active boolean"
)
NOON = datetime(2024, 5, 1, 6, 30)


def coupon(id_, code, kind, value="0", cap=None, floor="0", buy=None, get=None, scope="all", ids=(), cats=(), first=None, last=None, uses=None, per=None, active=True):
    return (id_, code, kind, D(value), D(cap) if cap else None, D(floor), buy, get, scope, list(ids), list(cats), first, last, uses, per, active)


def settle(spark, coupons, menu, lines, asked):
    out = C.settlement(spark.createDataFrame(asked, BILLS), spark.createDataFrame(lines, LINES), spark.createDataFrame(coupons, COUPON), spark.createDataFrame(menu, MENU))
    return {r.id: r for r in out.collect()}


def test_recipe_explosion(spark):
    lines = spark.createDataFrame([(1, 10, 2)], LINES)
    recipe = spark.createDataFrame([(10, 1, D("150.000")), (10, 2, D("10.000"))], "menu_item_id bigint, ingredient_id bigint, qty decimal(12,3)")
    parts = spark.createDataFrame([(1, "Batter", "g"), (2, "Oil", "ml")], "id bigint, name string, unit string")
    got = {r.ingredient_name: r.qty for r in bills.recipe_explosion(lines, recipe, parts).collect()}
    assert got == {"Batter": D("300.000"), "Oil": D("20.000")}


def test_coupon_reasons_and_amounts(spark):
    menu = [(i, f"m{i}", "A" if i < 5 else "B", D(p), True) for i, p in enumerate(["10", "20", "30", "40", "1200", "180", "0.20"], 1)]
    coupons = [
        coupon(1, "B1G1", "bogo", buy=1, get=1),
        coupon(2, "B2G1", "bogo", buy=2, get=1),
        coupon(3, "HALF", "percent", "50", cap="500"),
        coupon(4, "FLAT", "flat", "250"),
        coupon(5, "EIGHTH", "percent", "12.5"),
        coupon(6, "OFF", "percent", "10", active=False),
        coupon(7, "LATER", "flat", "5", first=date(2024, 6, 1)),
        coupon(8, "GONE", "flat", "5", last=date(2024, 4, 1)),
        coupon(9, "BIG", "flat", "5", floor="100000"),
        coupon(10, "ONLYB", "flat", "5", scope="items", cats=["B"]),
        coupon(11, "ONCE", "flat", "5", per=1),
    ]
    lines = [(1, i, 1) for i in (1, 2, 3, 4)] + [(2, 1, 2), (3, 5, 1), (4, 6, 1), (5, 7, 1)] + [(k, 1, 1) for k in range(6, 14)]
    asked = [(k, None, NOON, "paid", c) for k, c in enumerate([" b1g1 ", "B2G1", "half", "FLAT", "EIGHTH", "OFF", "LATER", "GONE", "BIG", "ONLYB", "ONCE", "NOPE", " "], 1)]
    got = settle(spark, coupons, menu, lines, asked)
    assert [got[k].discount for k in (1, 3, 4, 5)] == [D("30.00"), D("500.00"), D("180.00"), D("0.03")]
    reasons = {k: got[k].reason for k in got}
    assert reasons == {
        1: None, 2: "too few items", 3: None, 4: None, 5: None, 6: "off", 7: "not started", 8: "expired", 9: "below minimum",
        10: "nothing covered", 11: "needs phone", 12: "unknown", 13: "no code",
    }


def test_two_limits(spark):
    menu = [(1, "m", "A", D("100"), True)]
    people = ["a", "a", "b", "c", "d"]
    asked = [(k, p, datetime(2024, 5, 1, 6, k), "paid", "X") for k, p in enumerate(people, 1)]
    got = settle(spark, [coupon(1, "X", "flat", "5", uses=3, per=1)], menu, [(k, 1, 1) for k in range(1, 6)], asked)
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "customer limit", 3: None, 4: None, 5: "used up"}


@pytest.mark.parametrize("clock, inside", [("16:59", False), ("17:00", True), ("01:59", True), ("02:00", False)])
def test_login_window_wraps(spark, clock, inside):
    h, m = map(int, clock.split(":"))
    got = spark.range(1).select(access.in_login_window(F.lit("admin"), F.lit("17:00"), F.lit("02:00"), F.lit(h * 60 + m))).first()[0]
    assert got is inside


def test_lockout(spark):
    rows = [(k, "u", f"ip{k}", False, datetime(2024, 1, 1, 10, k)) for k in range(1, 6)] + [(6, "u", "ip6", False, datetime(2024, 1, 1, 10, 6))]
    df = spark.createDataFrame(rows, "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz")
    last = A.lockouts(df).filter("id = 6").first()
    assert (last.user_failures, last.lock, last.wait_minutes) == (5, "user", 10)
    assert A.locked_users(df, datetime(2024, 1, 1, 10, 6)).first().wait_minutes == 10


def test_local_day_edge(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 18, 29, 59),), (datetime(2024, 1, 1, 18, 30),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(T.local_day(F.col("ts"))).collect()] == [date(2024, 1, 1), date(2024, 1, 2)]
    one = T.DayRange.resolve("2024-01-02")
    assert df.filter(one.contains(F.col("ts"))).count() == 1


def test_range_rules():
    assert T.DayRange.resolve(as_of=datetime(2024, 1, 1, 20)).first == date(2024, 1, 2)
    for bad in (("2024-01-02", "2024-01-01"), ("2023-01-01", "2024-01-03")):
        with pytest.raises(ValueError):
            T.DayRange.resolve(*bad)
    assert T.DayRange.resolve("2023-01-01", "2024-01-02").last == date(2024, 1, 2)
    assert T.DayRange.resolve("1990-01-01", "2024-01-02", max_span=None).first == date(1990, 1, 1)


def test_shift(spark):
    opened = datetime(2024, 1, 1, 4)
    sh = spark.createDataFrame([(1, 7, opened, datetime(2024, 1, 1, 12), D("500"), 7, D("1690"))], "id bigint, admin_id bigint, opened_at timestamp_ntz, closed_at timestamp_ntz, opening_cash decimal(10,2), closed_by bigint, counted_cash decimal(10,2)")
    orders = spark.createDataFrame(
        [(1, 7, datetime(2024, 1, 1, 5), D("1200"), "paid", "cash"), (2, 7, datetime(2024, 1, 1, 6), D("300"), "pending", "upi"), (3, 7, datetime(2024, 1, 1, 12), D("9"), "paid", "cash")],
        "id bigint, created_by bigint, created_at timestamp_ntz, total decimal(10,2), payment_status string, payment_method string",
    )
    admins = spark.createDataFrame([(7, "asha")], "id bigint, username string")
    r = shifts.reconcile(sh, orders, admins, datetime(2024, 1, 2)).first()
    assert (r.expected_cash, r.difference, r.label, r.pending_total, r.closed_by_name) == (D("1700.00"), D("-10.00"), "Short by", D("300.00"), "asha")
    frozen = shifts.reconcile(sh.withColumn("expected_cash", F.lit(D("1690.00"))), orders, admins, datetime(2024, 1, 2)).first()
    assert (frozen.expected_cash, frozen.label) == (D("1690.00"), "Exact match")
    closed = shifts.reconcile(sh.withColumn("totals", F.lit('{"orders":2,"sales":900.5,"cash":900.5}')), orders, admins, datetime(2024, 1, 2)).first()
    assert (closed.orders, closed.sales, closed.pending_total, closed.expected_cash) == (2, D("900.50"), D("0.00"), D("1400.50"))


def test_ledger(spark):
    kinds = [("purchase", "5"), ("waste", "2"), ("count", "20"), ("sale", "4"), ("purchase", "0")]
    ev = spark.createDataFrame([(i, 1, k, D(q), None, datetime(2024, 1, 1, i)) for i, (k, q) in enumerate(kinds, 1)], "id bigint, ingredient_id bigint, kind string, qty decimal(14,3), order_id bigint, created_at timestamp_ntz")
    start = spark.createDataFrame([(1, D("10"))], "id bigint, stock decimal(14,3)")
    got = [(r.kind, int(r.qty), int(r.balance_after)) for r in stock.stock_ledger(ev, start).orderBy("id").collect()]
    assert got == [("purchase", 5, 15), ("waste", -2, 13), ("adjust", 7, 20), ("sale", -4, 16)]


def test_can_make(spark):
    recipe = spark.createDataFrame([(1, 1, D("20")), (1, 2, D("3"))], "menu_item_id bigint, ingredient_id bigint, qty decimal(12,3)")
    parts = "id bigint, name string, unit string, track_stock boolean, stock decimal(14,3), low_stock_at decimal(14,3)"
    make = lambda alert: stock.menu_stock(recipe, spark.createDataFrame([(1, "a", "g", True, D("50"), alert), (2, "b", "g", True, D("9"), None)], parts)).first()
    assert (make(None).can_make, make(None).status, make(D("50")).status) == (2, "ok", "low")
    assert [s.name for s in make(D("50")).short] == ["a"]


def test_json_diff(spark):
    pairs = [
        ('{"price":10,"name":"A"}', '{"price":12,"name":"A"}', '{"price":[10,12]}'),
        ('{"a":1}', '{"a":1.0}', "{}"),
        ('{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', "{}"),
        ('{"a":null}', "{}", '{"a":[null,null]}'),
        ('{"a":"1"}', '{"a":1}', '{"a":["1",1]}'),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    for r in df.select(diff.changes_json(diff.json_diff(F.col("a"), F.col("b"))).alias("got"), "want").collect():
        assert r.got == r.want
    assert all(r[0] == "{}" for r in df.select(diff.changes_json(diff.json_diff(F.col("a"), F.col("a")))).collect())


def test_hours(spark):
    shops = spark.createDataFrame([(1, '{"mon":{"open":"07:00","close":"22:00"}}'), (2, '{"fri":{"open":"7:00","close":"22:00"}}'), (3, None)], "shop_id bigint, opening_hours string")
    rows = hours.normalise_hours(shops).collect()
    assert sorted((r.day, r.closed) for r in rows if r.shop_id == 1) == sorted([("mon", False)] + [(d, True) for d in hours.WEEK[1:]])
    assert {r.error for r in rows if r.shop_id == 2} == {"Enter opening and closing times for Fri as HH:MM, or mark it closed."}
    assert not [r for r in rows if r.shop_id == 3]
    week = hours.valid_week(shops.filter("shop_id = 1"))
    at = lambda day, minute: hours.open_state(week.withColumn("weekday", F.lit(day)).withColumn("minute", F.lit(minute))).first()
    assert at(0, 420).is_open and not at(0, 1320).is_open
    assert (at(0, 1320).opens_in_days, at(0, 60).opens_in_days, at(6, 0).opens_in_days, at(6, 0).opens_at) == (7, 0, 1, 420)


def test_labels(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(labels.big_unit(F.lit(D("1500.000")), F.lit("g"))) == "1.5 kg"
    assert val(labels.big_unit(F.lit(D("999.000")), F.lit("g"))) is None
    assert val(labels.plain_number(F.lit(D("300.000")), 3)) == "300"
    assert val(labels.share_pct(F.lit(D("1.00")), F.lit(D("0.00")))) == 0
    assert val(clean.digits(F.lit("+91 (98) x"))) == "9198"
    assert val(clean.client_ip(F.lit('{"x-forwarded-for":" , 1.1.1.1"}'))) is None


def test_average_rounds_half_up(spark):
    df = spark.createDataFrame([(D("0.01"), 2), (D("10.00"), 3), (D("0.00"), 0)], "s decimal(24,2), n bigint")
    assert [r[0] for r in df.select(reports.average(F.col("s"), F.col("n"))).collect()] == [D("0.01"), D("3.33"), D("0.00")]
