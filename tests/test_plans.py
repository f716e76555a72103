"""What the printed plans must show."""

import pytest
from pyspark.sql import functions as F

from tillworks import catalog
from tillworks.functions.access import minute_of
from tillworks.operators.prefix import numbered_in_order
from tillworks.streaming.state import BatchLog

BOUNDED = ["sales_summary", "sales_by_method", "sales_by_day", "sales_by_hour", "busy_hours", "sales_by_staff", "top_items", "ingredient_usage", "usage_coverage",
           "join_items_orders", "favourites", "public_menu", "public_kitchen", "lane_top_n", "kitchen_queue", "kitchen_board", "today_counters", "range_presets", "new_since_last"]


@pytest.mark.parametrize("key", BOUNDED)
def test_day_bounds_reach_the_scan(spark, folder, key):
    plan = catalog.queries()[key](spark, folder)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert scans and all("GreaterThan(o_orderdate" in line for line in scans)


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = numbered_in_order(rows, [F.col("v")], "pos").collect()
    assert [r.pos for r in sorted(got)] == list(range(1, 1001))
    assert numbered_in_order(rows.where("false"), [F.col("v")], "pos").count() == 0


def test_times_of_day(spark):
    texts = ["09:00", "9:05", "9", "9:00:30", "25:99", "24:00", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(minute_of(F.col("t")).alias("m"))
    assert [r.m for r in got.collect()] == [540, 545] + [None] * 6


def test_a_missing_batch_is_an_error(spark, run_dir):
    log = BatchLog(f"{run_dir}/log", "id bigint")
    log.write(spark.range(3), 0)
    assert log.before(spark, 1).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        log.before(spark, 2).count()
