"""Payloads with quoted and malformed numbers."""

from pyspark.sql import functions as F

from tillworks.functions.access import minute_of
from tillworks.sources import payloads


def test_quoted_numbers_count_and_malformed_ones_do_not_stop_the_job(spark):
    text = '[{"menu_item_id":"7","qty":"2"},{"menu_item_id":8,"qty":3},{"menu_item_id":"x","qty":"y"}]'
    bills = spark.createDataFrame([(1, text), (2, '{"a":1}'), (3, "[]"), (4, None)], "id long, items string")
    got = sorted(tuple(r) for r in payloads.explode_bill_items(bills).collect())
    assert got == [(1, 0, 7, 2), (1, 1, 8, 3), (1, 2, None, None)]


def test_recipe_takes_quoted_ids_and_refuses_malformed_ones(spark):
    rows = [(1, '[{"ingredient_id":"5","qty":"1.5"}]'), (2, '[{"ingredient_id":5,"qty":"much"}]')]
    staged = spark.createDataFrame(rows, "menu_item_id long, items string")
    assert [(r[0], r[1], float(r[2])) for r in payloads.explode_recipe_items(staged).collect()] == [(1, 5, 1.5)]
    errors = {r[0]: r[1] for r in staged.select("menu_item_id", payloads.recipe_payload_error(F.col("items"))).collect()}
    assert errors[1] is None and errors[2]


def test_id_lists_and_hours_survive_bad_text(spark):
    row = spark.range(1).select(
        payloads.id_list(F.lit('["7","x",3,"7"]')).alias("ids"), minute_of(F.lit("9:05")).alias("short"), minute_of(F.lit("21:30")).alias("full"), minute_of(F.lit("late")).alias("bad")
    )
    assert tuple(row.first()) == ([3, 7], 545, 1290, None)


def test_coupon_with_a_malformed_number_is_refused(spark):
    from tillworks.functions import messages
    from tillworks.operators.maintain import coupon_edits

    make = lambda value: f'{{"code":"TEN{len(value)}","kind":"flat","value":"{value}"}}'
    staged = spark.createDataFrame([(1, 901, True, make("abc")), (2, 902, True, make("10"))], "seq long, id long, is_new boolean, payload string")
    none = spark.createDataFrame([], "id long, code string")
    got = {r["id"]: r["error"] for r in coupon_edits(staged, none).collect()}
    assert got == {901: messages.BAD_COUPON_NUMBER, 902: None}


def test_a_bill_with_a_malformed_line_is_refused(spark):
    """One unreadable number refuses the whole bill instead of making it smaller; quoted numbers and absent ones do not."""
    from tillworks.plans.bills import checked_bills

    texts = ['[{"menu_item_id":1,"qty":2}]', '[{"menu_item_id":1,"qty":2},{"menu_item_id":2,"qty":"two"}]', '[{"menu_item_id":"x","qty":1}]', '[{"menu_item_id":"3","qty":" 4 "}]', '[{"menu_item_id":1}]', "[]", None]
    rows = [(i, None, None, "cash", None, t, None) for i, t in enumerate(texts)]
    bills = spark.createDataFrame(rows, "id bigint, phone string, customer_name string, payment_method string, coupon_code string, items string, created_by bigint")
    bills = bills.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.id: r.error for r in checked_bills(bills).collect()}
    bad = "An item number or quantity of the bill cannot be read."
    assert got == {0: None, 1: bad, 2: bad, 3: None, 4: None, 5: "Add at least one item.", 6: "Add at least one item."}
