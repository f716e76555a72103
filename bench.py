"""Benchmark: runs the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_KEYS`` (comma list, or
``all``). Results are written to Spark's ``noop`` sink, so every row is computed and none
reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from tillworks import catalog
from tillworks.config import local_session

HEADLINE = [
    "sales_report", "sales_summary", "sales_by_day", "top_items", "ingredient_usage", "usage_coverage", "usage_report", "local_range_filter",
    "recipe_explosion", "bill_ingredient_need", "menu_stock", "public_menu", "nested_items", "order_document", "order_search_page",
    "orders_by_phone", "customer_spend", "coupon_line_sums", "coupon_quote", "bogo_cheapest_units", "coupon_settlement", "coupon_catalogue",
    "shift_order_range_join", "shift_reconcile", "kitchen_board", "public_kitchen", "bill_intake", "stock_deduct", "stock_ledger", "stock_restore",
    "login_lockout", "session_gate", "session_state", "menu_upsert", "snapshot_diff", "cascade_delete", "constraint_audit", "audit_feed",
    "payment_transition", "open_state", "stream_stock", "stream_sales_day_hour", "stream_kitchen_board", "stream_shift_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries = catalog.queries()
    wanted = os.environ.get("BENCH_KEYS", "")
    keys = list(queries) if wanted == "all" else [k for k in wanted.split(",") if k] or HEADLINE
    # Starts the executor threads and the code generator; not timed.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().orderBy("count").collect()
    seconds = {}
    for key in keys:
        started = time.perf_counter()
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
