"""Public menu, kitchen boards and paged lists assembled from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions import labels
from tillworks.functions import timeutil as T
from tillworks.operators import kitchen as K
from tillworks.operators import pages as P
from tillworks.operators import stock as S
from tillworks.plans import reports as R


def public_menu(menu: DataFrame, recipes: DataFrame, ingredients: DataFrame, orders: DataFrame, lines: DataFrame, as_of) -> DataFrame:
    """Active items with their stock state and, for the favourites, their place."""
    status = S.menu_stock(recipes, ingredients).select(F.col("menu_item_id").alias("id"), F.col("status"))
    liked = R.favourites(orders, lines, menu, as_of)
    ranked = liked.agg(F.sort_array(F.collect_list(F.struct((-F.col("qty")).alias("q"), F.col("menu_item_id")))).alias("f"))
    places = ranked.select(F.posexplode("f").alias("p", "e")).select(F.col("e.menu_item_id").alias("id"), (F.col("p") + 1).alias("favourite"))
    rows = menu.filter("is_active").join(status, "id", "left").join(places, "id", "left")
    return rows.select("id", "name", "category", "price", F.coalesce("status", F.lit("ok")).alias("stock"), "favourite").orderBy("category", "name", "id")


def public_kitchen(orders: DataFrame, items, as_of, hours: int = 12, n: int = 12) -> DataFrame:
    """Lanes of the public board with item texts and no personal fields.

    ``items`` is called with the kept bills and returns their numbered lines, so only
    board bills are ever numbered and nested.
    """
    board = K.lane_top_n(K.open_orders(orders, as_of, hours), n).select("id", "lane", "pos", "created_at", "kitchen_updated_at")
    full = P.with_items(board, items(board))
    return full.select("id", "lane", "pos", "created_at", "kitchen_updated_at", P.items_text(F.col("items")).alias("items"))


def kitchen_board(orders: DataFrame, items, as_of) -> DataFrame:
    """Staff board: active queue and last served bills with items and age class."""
    queue = K.kitchen_queue(orders, as_of)
    full = P.with_items(queue, items(queue))
    minutes = T.minutes_between(F.col("created_at"), T.instant(as_of))
    return full.select(
        "id", "board", "customer_name", "kitchen_status", "payment_status", "created_at", minutes.alias("minutes"),
        labels.late_class(minutes).alias("late"), P.items_text(F.col("items")).alias("items"),
    )


def order_search_page(orders: DataFrame, admins: DataFrame, items, term: str | None, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page of matching bills with author and items. Rows are cut first, then widened."""
    rows = P.orders_page(orders, admins, term, limit, offset)
    full = P.with_items(rows, items(rows))
    return full.select("id", "phone", "customer_name", "total", "payment_status", "author", "created_at", P.items_text(F.col("items")).alias("items"))


def pending_page(orders: DataFrame, admins: DataFrame, items, n: int = 50) -> DataFrame:
    rows = P.with_author(P.pending_orders(orders, n), admins)
    full = P.with_items(rows, items(rows), empty=True)
    return full.select("id", "total", "author", "created_at", F.size("items").alias("lines"), P.items_text(F.col("items")).alias("items"))


def phone_history(orders: DataFrame, items, phone: str, n: int = 100) -> DataFrame:
    rows = P.orders_by_phone(orders, phone, n)
    full = P.with_items(rows, items(rows))
    return full.select("id", "customer_name", "total", "payment_status", "payment_method", "created_at", P.items_text(F.col("items")).alias("items"))


def customer_spend(orders: DataFrame) -> DataFrame:
    """Bills and spend per phone, cancelled bills not counted in the spend."""
    spent = F.when(K.not_cancelled(), F.col("total"))
    return orders.filter("phone is not null").groupBy("phone").agg(
        F.count("*").alias("orders"), F.coalesce(F.sum(spent), F.lit(0)).cast("decimal(24,2)").alias("total")
    )


def order_documents(orders: DataFrame, items: DataFrame, admins: DataFrame) -> DataFrame:
    """Receipts laid flat: one row per line, bills without lines keep one row with none."""
    head = P.with_author(orders, admins).select(F.col("id").alias("order_id"), "phone", "customer_name", "discount", "total", "payment_status", "author")
    lines = items.select("order_id", "line_no", F.col("item_name").alias("name"), "price", "qty")
    return head.join(lines, "order_id", "left")
