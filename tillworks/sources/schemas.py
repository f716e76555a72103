"""Explicit schemas; no job infers one.

DDL text per table. ``RAW`` describes the driver's parquet tables, ``SHOP`` the shop's own tables.
Instants are ``timestamp_ntz`` in UTC.
"""

from __future__ import annotations

RAW: dict[str, str] = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
}

SHOP: dict[str, str] = {
    "menu_items": (
        "id bigint not null, name string not null, category string not null, price decimal(10,2) not null, "
        "image_url string, is_active boolean not null, created_at timestamp_ntz not null"
    ),
    "customers": ("phone string not null, name string, created_at timestamp_ntz not null"),
    "orders": (
        "id bigint not null, phone string, customer_name string, subtotal decimal(10,2), "
        "discount decimal(10,2) not null, total decimal(10,2) not null, coupon_id bigint, coupon_code string, "
        "payment_status string not null, payment_method string, paid_at timestamp_ntz, "
        "kitchen_status string not null, kitchen_updated_at timestamp_ntz, created_by bigint, "
        "created_at timestamp_ntz not null"
    ),
    "order_items": (
        "id bigint not null, order_id bigint not null, menu_item_id bigint, item_name string not null, "
        "price decimal(10,2) not null, qty int not null"
    ),
    "order_item_ingredients": (
        "id bigint not null, order_id bigint not null, order_item_id bigint not null, ingredient_id bigint, "
        "ingredient_name string not null, unit string not null, qty decimal(14,3) not null"
    ),
    "ingredients": (
        "id bigint not null, name string not null, unit string not null, track_stock boolean not null, "
        "stock decimal(14,3) not null, low_stock_at decimal(14,3), created_at timestamp_ntz not null"
    ),
    "menu_item_ingredients": ("menu_item_id bigint not null, ingredient_id bigint not null, qty decimal(12,3) not null"),
    "stock_movements": (
        "id bigint not null, ingredient_id bigint not null, kind string not null, qty decimal(14,3) not null, "
        "balance_after decimal(14,3) not null, order_id bigint, admin_id bigint, note string, "
        "created_at timestamp_ntz not null"
    ),
    "coupons": (
        "id bigint not null, code string not null, description string, kind string not null, "
        "value decimal(10,2) not null, max_discount decimal(10,2), min_bill decimal(10,2) not null, buy_qty int, "
        "get_qty int, applies_to string not null, item_ids array<bigint> not null, categories array<string> not null, "
        "valid_from date, valid_to date, usage_limit int, per_customer_limit int, is_active boolean not null, "
        "created_by bigint, created_at timestamp_ntz not null, updated_at timestamp_ntz not null"
    ),
    "shifts": (
        "id bigint not null, admin_id bigint, opened_at timestamp_ntz not null, opening_cash decimal(10,2) not null, "
        "closed_at timestamp_ntz, closed_by bigint, counted_cash decimal(10,2), expected_cash decimal(10,2), "
        "difference decimal(10,2), totals string, note string"
    ),
    "admins": (
        "id bigint not null, username string not null, role string not null, is_active boolean not null, "
        "login_from string, login_to string, auto_approve boolean not null, last_login_at timestamp_ntz, "
        "created_at timestamp_ntz not null"
    ),
    "admin_sessions": (
        "id bigint not null, admin_id bigint not null, ip string, approved_at timestamp_ntz, approved_by bigint, "
        "created_at timestamp_ntz not null, expires_at timestamp_ntz not null"
    ),
    "login_attempts": (
        "id bigint not null, username string not null, ip string, succeeded boolean not null, "
        "created_at timestamp_ntz not null"
    ),
    "audit_log": (
        "id bigint not null, admin_id bigint, admin_username string, action string not null, entity_id string, "
        "details string not null, created_at timestamp_ntz not null"
    ),
    "settings": (
        "id bigint not null, shop_name string not null, shop_address string, shop_phone string, "
        "currency string not null, upi_id string, country_code string not null, receipt_footer string not null, "
        "hide_out_of_stock boolean not null, tagline string, whatsapp string, maps_url string, "
        "cover_image_url string, opening_hours string"
    ),
}


def read_shop_table(spark, name: str, path: str):
    """Typed scan of a shop table; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.schema(SHOP[name]).parquet(path)
