"""Shop tables derived from the driver's parquet tables.

Every property is a lazy DataFrame: only the columns and rows a plan asks for
are read. Dimensions that grow with the data carry no broadcast hint; Spark
broadcasts them only while their size is under its threshold.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions import timeutil as T
from tillworks.operators.prefix import running_sum
from tillworks.sources.schemas import RAW

MONEY = "decimal(10,2)"
QTY = "decimal(14,3)"
KITCHEN_DELAY = timedelta(seconds=600)  # from a bill to its kitchen change in these tables

# Fixed coupon catalogue used by the registered queries (a literal table of ten rows).
COUPON_ROWS = [
    (1, "PCT10", "percent", "10.00", None, "0.00", None, None, "all", [], [], None, None, 5, None, True),
    (2, "PCT50", "percent", "50.00", "500.00", "1000.00", None, None, "all", [], [], None, None, None, 1, True),
    (3, "FLAT100", "flat", "100.00", None, "0.00", None, None, "all", [], [], None, None, 20, None, True),
    (4, "FLATSM", "flat", "250.00", None, "500.00", None, None, "items", [], ["SMALL"], None, None, None, None, True),
    (5, "B1G1", "bogo", "0.00", None, "0.00", 1, 1, "all", [], [], None, None, None, None, True),
    (6, "B2G1", "bogo", "0.00", "5000.00", "0.00", 2, 1, "items", [], ["PROMO"], None, None, None, 2, True),
    (7, "OFF", "percent", "10.00", None, "0.00", None, None, "all", [], [], None, None, None, None, False),
    (8, "LATER", "flat", "50.00", None, "0.00", None, None, "all", [], [], "2001-01-01", None, None, None, True),
    (9, "GONE", "percent", "12.50", "300.00", "0.00", None, None, "all", [], [], None, "1997-12-31", None, None, True),
    (10, "PICKED", "percent", "20.00", None, "50000.00", None, None, "items", [1, 2, 3, 999999999], ["ECONOMY"], "1996-01-01", "2000-12-31", 400, 2, True),
]
COUPON_DDL = (
    "id bigint, code string, kind string, value string, max_discount string, min_bill string, buy_qty int, "
    "get_qty int, applies_to string, item_ids array<bigint>, categories array<string>, valid_from string, "
    "valid_to string, usage_limit int, per_customer_limit int, is_active boolean"
)


def order_created_at(key: Column, day: Column) -> Column:
    return F.timestamp_add("SECOND", (key * 7919) % 86400, day)


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """Line numbers within each bill, in the order of its line number, item and the rest.

    Counted per slice of (line number, a million item ids), so even a bill holding a
    large part of all lines spreads over many tasks.
    """
    slice_ = F.col("l_linenumber") * F.lit(10**12) + F.floor(F.col("l_partkey") / 1_000_000)
    return running_sum(items, ["order_id"], order, slice_, line_no=F.lit(1))


class Tables:
    """The shop's tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def admins(self) -> DataFrame:
        k = F.col("s_suppkey")
        band = k % 3
        return self.raw("supplier").select(
            k.alias("id"),
            F.concat(F.lit("staff"), k.cast("string")).alias("username"),
            F.when(k % 10 == 0, "super").otherwise("admin").alias("role"),
            (k % 9 != 0).alias("is_active"),
            F.when(band == 1, "09:00").when(band == 2, "17:00").alias("login_from"),
            F.when(band == 1, "22:00").when(band == 2, "02:00").alias("login_to"),
            (k % 2 == 0).alias("auto_approve"),
        )

    @cached_property
    def menu(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            (F.col("p_partkey") % 11 != 0).alias("is_active"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").filter(k % 10 != 0).select(
            (F.lit(9000000000) + k).cast("string").alias("phone"), F.col("c_name").alias("name")
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders(self.raw("orders"))

    def orders_between(self, days: T.DayRange) -> DataFrame:
        """Orders of a range of local days, pruned at the scan to the raw days it can touch.

        ``created_at`` is computed from the stored day, so the exact bounds cannot
        reach the scan; the implied bounds on the stored day can.
        """
        day = F.col("o_orderdate")
        raw = self.raw("orders").filter((day > T.instant(days.start - timedelta(days=1))) & (day < T.instant(days.end)))
        return self._orders(raw).filter(days.contains(F.col("created_at")))

    def orders_since(self, start: datetime) -> DataFrame:
        """Orders made or changed in the kitchen at ``start`` or later, pruned at the scan likewise.

        A bill's last kitchen change comes at most ``KITCHEN_DELAY`` after it was made.
        """
        raw = self.raw("orders").filter(F.col("o_orderdate") > T.instant(start - timedelta(days=1) - KITCHEN_DELAY))
        return self._orders(raw).filter(F.greatest("created_at", "kitchen_updated_at") >= T.instant(start))

    def _orders(self, raw: DataFrame) -> DataFrame:
        k, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        second = (k * 7919) % 86400
        named = cust % 10 != 0
        return raw.select(
            k.alias("id"),
            F.when(named, (F.lit(9000000000) + cust).cast("string")).alias("phone"),
            F.when(named, F.concat(F.lit("Customer "), cust.cast("string"))).alias("customer_name"),
            F.col("o_totalprice").cast(MONEY).alias("total"),
            F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled").alias("payment_status"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "cash")
            .when(F.col("o_orderpriority") == "2-HIGH", "upi")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "card")
            .alias("payment_method"),
            F.when(k % 4 == 0, "new").when(k % 4 == 1, "preparing").when(k % 4 == 2, "ready").otherwise("served").alias("kitchen_status"),
            F.when(k % 4 != 0, F.timestamp_add("SECOND", second + int(KITCHEN_DELAY.total_seconds()), day)).alias("kitchen_updated_at"),
            F.when(cust % 20 != 0, cust % 20).alias("created_by"),
            F.when(k % 5 == 0, k % 12 + 1).alias("coupon_id"),
            F.when(k % 5 == 0, F.lit(5)).otherwise(F.lit(0)).cast(MONEY).alias("discount"),
            F.timestamp_add("SECOND", second, day).alias("created_at"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Ordered quantities without menu data: (order_id, menu_item_id, qty)."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("l_quantity").cast("int").alias("qty"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Order lines with the snapshot name and price."""
        menu = self.menu.select(F.col("id").alias("menu_item_id"), F.col("name").alias("item_name"), "price")
        return self.order_lines.join(menu, "menu_item_id").select("order_id", "menu_item_id", "item_name", "price", "qty")

    def numbered_items(self, orders: DataFrame | None = None) -> DataFrame:
        """Order lines with a line number, for bills that are shown line by line.

        ``orders`` (with an ``id`` column) restricts the numbering to those bills.
        """
        part = self.raw("part").select("p_partkey", F.col("p_name").alias("item_name"), F.col("p_retailprice").cast(MONEY).alias("price"))
        lines = self.raw("lineitem").withColumnRenamed("l_orderkey", "order_id")
        if orders is not None:
            lines = lines.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
        return numbered(lines, order).select(
            "order_id", "line_no", F.col("l_partkey").alias("menu_item_id"), "item_name", "price", F.col("l_quantity").cast("int").alias("qty")
        )

    @cached_property
    def ingredients(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            F.col("s_name").alias("name"),
            F.when(k % 5 == 0, "g").when(k % 5 == 1, "kg").when(k % 5 == 2, "ml").when(k % 5 == 3, "l").otherwise("pcs").alias("unit"),
            (k % 4 != 0).alias("track_stock"),
            F.col("s_acctbal").cast(QTY).alias("stock"),
            F.when(k % 3 == 0, F.lit(2000).cast(QTY)).alias("low_stock_at"),
        )

    @cached_property
    def recipes(self) -> DataFrame:
        n_ingredients = self.raw("supplier").agg(F.count("*")).scalar()
        step = F.col("k").cast("bigint")
        return (
            self.raw("part")
            .filter(F.col("p_partkey") % 6 != 0)
            .select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("k"))
            .select(
                F.col("p_partkey").alias("menu_item_id"),
                ((F.col("p_partkey") * 7 + step * 13) % n_ingredients).alias("ingredient_id"),
                (F.col("p_size") * (F.col("k") + 1)).cast("decimal(12,3)").alias("qty"),
            )
        )

    @cached_property
    def logins(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").filter(F.col("event_type").isin("error", "signup")).select(
            e.alias("id"),
            F.concat(F.lit("staff"), (F.col("user_id") % 25).cast("string")).alias("username"),
            F.concat(F.lit("10.0.0."), (e % 40).cast("string")).alias("ip"),
            (F.col("event_type") != "error").alias("succeeded"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def login_bursts(self) -> DataFrame:
        """The same attempts with time squeezed 240 times and fewer addresses, so that limits are reached."""
        start = T.instant("2024-01-01")
        squeezed = F.floor(F.timestamp_diff("MICROSECOND", start, F.col("created_at")) / 240)
        return self.logins.select(
            "id",
            "username",
            F.concat(F.lit("10.0.0."), (F.col("id") % 8).cast("string")).alias("ip"),
            "succeeded",
            F.timestamp_add("MICROSECOND", squeezed, start).alias("created_at"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """One session per successful sign-in."""
        e = F.col("event_id")
        return self.raw("events").filter(F.col("event_type") == "signup").select(
            e.alias("id"),
            (F.col("user_id") % 25).alias("admin_id"),
            F.concat(F.lit("10.0.0."), (e % 40).cast("string")).alias("ip"),
            F.when(e % 3 != 0, F.timestamp_add("SECOND", F.lit(60), F.col("ts"))).alias("approved_at"),
            F.when(e % 3 != 0, (e % 2) * 10).alias("approved_by"),
            F.col("ts").alias("created_at"),
            F.timestamp_add("HOUR", F.lit(12), F.col("ts")).alias("expires_at"),
        )

    @cached_property
    def session_events(self) -> DataFrame:
        """Sign-in life cycle: a login, then approve / deny / logout / revoke for some sessions."""
        s = self.sessions
        e = F.col("id")
        login = s.select(F.col("id").alias("session_id"), "admin_id", F.lit("login").alias("event"), F.col("created_at").alias("ts"))
        answer = s.filter(e % 4 != 0).select(
            F.col("id").alias("session_id"),
            "admin_id",
            F.when(e % 4 == 1, "approve").when(e % 4 == 2, "deny").otherwise("approve").alias("event"),
            F.timestamp_add("MINUTE", F.lit(5), F.col("created_at")).alias("ts"),
        )
        leave = s.filter(e % 4 == 3).select(
            F.col("id").alias("session_id"),
            "admin_id",
            F.when(e % 8 == 3, "logout").otherwise("revoke").alias("event"),
            F.timestamp_add("HOUR", F.lit(3), F.col("created_at")).alias("ts"),
        )
        return login.unionByName(answer).unionByName(leave)

    @cached_property
    def audit(self) -> DataFrame:
        t = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("staff"), (F.col("user_id") % 20).cast("string")).alias("admin_username"),
            F.when(t == "click", "order.status")
            .when(t == "view", "kitchen.status")
            .when(t == "purchase", "stock.purchase")
            .when(t == "signup", "staff.create")
            .otherwise("menu.update")
            .alias("action"),
            F.col("user_id").cast("string").alias("entity_id"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def audit_documents(self) -> DataFrame:
        """The audit log with details shaped like each action's own document."""
        k = (F.col("id") % 100).cast("string")
        details = (
            F.when(F.col("action") == "order.status", F.concat(F.lit('{"from":"pending","to":"'), F.when(F.col("id") % 2 == 0, "paid").otherwise("cancelled"), F.lit('"}')))
            .when(F.col("action") == "kitchen.status", F.lit('{"from":"new","to":"preparing"}'))
            .when(F.col("action") == "stock.purchase", F.concat(F.lit('{"name":"Item '), k, F.lit('","unit":"g","before":10,"after":'), k, F.lit("}")))
            .when(F.col("action") == "staff.create", F.concat(F.lit('{"username":"user'), k, F.lit('","role":"admin"}')))
            .otherwise(F.concat(F.lit('{"name":"Dish '), k, F.lit('","changes":{"price":['), k, F.lit(",12],"), F.lit('"category":["A","B"]}}')))
        )
        return self.audit.withColumn("details", details)

    @cached_property
    def stock_events(self) -> DataFrame:
        t = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 100).alias("ingredient_id"),
            F.when(t == "purchase", "purchase").when(t == "view", "waste").when(t == "signup", "count").when(t == "click", "sale").otherwise("sale_reversal").alias("kind"),
            F.col("value").cast(QTY).alias("qty"),
            F.when(t.isin("click", "error"), F.col("event_id") % 500).alias("order_id"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        """Payment and kitchen status changes requested for each order, in time order."""
        t = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("order_id"),
            F.when(t.isin("purchase", "click"), "paid").when(t == "view", "pending").when(t == "signup", "pending").otherwise("cancelled").alias("payment_status"),
            F.when(F.col("event_id") % 4 == 0, "new").when(F.col("event_id") % 4 == 1, "preparing").when(F.col("event_id") % 4 == 2, "ready").otherwise("served").alias("kitchen_status"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def shifts(self) -> DataFrame:
        """One shift per staff member and month; ids are built per group, without a global window."""
        month = F.trunc(F.to_date("created_at"), "MM")
        first = (
            self.orders.filter(F.col("created_by").isNotNull())
            .groupBy(F.col("created_by").alias("admin_id"), month.alias("m"))
            .agg(F.min("created_at").alias("opened_at"))
        )
        closed = F.col("admin_id") % 7 != 0
        key = F.col("admin_id") * 1000000 + F.year("m") * 100 + F.month("m")
        return first.select(
            key.alias("id"),
            "admin_id",
            "opened_at",
            F.when(closed, F.timestamp_add("HOUR", F.lit(12), F.col("opened_at"))).alias("closed_at"),
            F.lit(500).cast(MONEY).alias("opening_cash"),
            F.when(closed, F.when(F.month("m") % 4 == 0, F.lit(0)).otherwise(F.col("admin_id"))).alias("closed_by"),
            F.when(closed, (F.lit(500) + F.month("m") * 1000)).cast(MONEY).alias("counted_cash"),
        )

    @cached_property
    def coupons(self) -> DataFrame:
        """Ten coupons that every branch of pricing meets, and one for each supplier."""
        money = lambda c: F.col(c).cast(MONEY).alias(c)
        names = [c.split()[0] for c in COUPON_DDL.split(", ")]
        text = json.dumps([dict(zip(names, row)) for row in COUPON_ROWS])
        rows = self.spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{COUPON_DDL}>>")))
        k = F.col("s_suppkey")
        percent, flat = k % 3 == 0, k % 3 == 1
        deal = F.when(~percent & ~flat, F.lit(1))
        rows = rows.unionByName(self.raw("supplier").select(
            (1000 + k).alias("id"), F.concat(F.lit("SUP-"), k.cast("string")).alias("code"),
            F.when(percent, "percent").when(flat, "flat").otherwise("bogo").alias("kind"),
            F.when(percent, 5 + k % 20).when(flat, 50 + k % 100).otherwise(0).cast("string").alias("value"),
            F.when(k % 4 == 0, F.lit("200")).alias("max_discount"), (k % 5 * 100).cast("string").alias("min_bill"),
            (deal * 2).alias("buy_qty"), deal.alias("get_qty"), F.when(k % 7 == 0, "items").otherwise("all").alias("applies_to"),
            F.when(k % 7 == 0, F.array(k + 1, k + 2)).otherwise(F.array().cast("array<bigint>")).alias("item_ids"), F.array().cast("array<string>").alias("categories"),
            F.lit(None).cast("string").alias("valid_from"), F.when(k % 6 == 0, F.lit("1997-12-31")).alias("valid_to"),
            F.when(k % 4 == 1, 10 + k % 50).cast("int").alias("usage_limit"), F.when(k % 5 == 2, 1).alias("per_customer_limit"), (k % 9 != 0).alias("is_active"),
        ))
        return rows.select(
            "id", "code", "kind", money("value"), money("max_discount"), money("min_bill"), "buy_qty", "get_qty", "applies_to",
            "item_ids", "categories", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"),
            "usage_limit", "per_customer_limit", "is_active",
            F.timestamp_add("DAY", F.col("id"), T.instant("1994-01-01")).alias("created_at"),
        )

    @cached_property
    def coupon_bills(self) -> DataFrame:
        """Bills that present a coupon code: some blank, some unknown, the others from the catalogue."""
        code = F.lit(None).cast("string")
        for row in COUPON_ROWS:
            code = F.when(F.col("id") % 12 == row[0], F.lit(f" {row[1].lower()} ")).otherwise(code)
        code = F.when(F.col("id") % 12 == 11, F.lit("NOPE")).when(F.col("id") % 12 == 0, F.lit(" ")).otherwise(code)
        return self.orders.select("id", "phone", "created_at", "payment_status", code.alias("code"))

    @cached_property
    def bills(self) -> DataFrame:
        """Raw bill payloads, one per order row, with the mistakes a till lets through."""
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        line = lambda j: F.concat(
            F.lit('{"menu_item_id":'), (cust + k % 5 + j * 17).cast("string"), F.lit(',"qty":'), ((k + j) % 4).cast("string"), F.lit("}")
        )
        body = (
            F.when(k % 3 == 0, line(0))
            .when(k % 3 == 1, F.concat_ws(",", line(0), line(1)))
            .otherwise(F.concat_ws(",", line(0), line(1), line(2), line(0)))
        )
        items = (
            F.when(k % 41 == 0, F.lit("[]"))
            .when(k % 43 == 0, F.lit('{"menu_item_id":1,"qty":1}'))
            .when(k % 47 == 0, F.lit(None))
            .otherwise(F.concat(F.lit("["), body, F.lit("]")))
        )
        phone = F.when(cust % 10 == 0, F.lit(" ")).when(k % 37 == 0, F.lit("98-76")).otherwise(
            F.concat(F.lit("("), (F.lit(90000) + cust % 1000).cast("string"), F.lit(") "), F.lpad((cust % 100000).cast("string"), 5, "0"))
        )
        code = F.lit(None).cast("string")
        for row in COUPON_ROWS:
            code = F.when(k % 24 == row[0], F.lit(f" {row[1].lower()} ")).otherwise(code)
        return self.raw("orders").select(
            k.alias("id"),
            phone.alias("phone"),
            F.when(k % 2 == 0, F.concat(F.lit(" Guest "), cust.cast("string"), F.lit(" "))).when(k % 5 == 0, F.lit("  ")).alias("customer_name"),
            F.when(k % 7 == 0, F.lit(" UPI ")).when(k % 7 == 1, F.lit("Card")).when(k % 53 == 0, F.lit("cheque")).when(k % 7 == 2, F.lit("CASH")).alias("payment_method"),
            F.when(k % 24 == 11, F.lit("NOPE")).otherwise(code).alias("coupon_code"),
            items.alias("items"),
            F.when(cust % 20 != 0, cust % 20).alias("created_by"),
            order_created_at(k, F.col("o_orderdate")).alias("created_at"),
        )

    @cached_property
    def settings(self) -> DataFrame:
        """Settings of many shops, one per customer row."""
        k = F.col("c_custkey")
        text = lambda v: F.lit(v).cast("string")
        return self.raw("customer").select(
            k.alias("id"), F.concat(F.lit("Shop "), k.cast("string")).alias("shop_name"), text(None).alias("shop_address"), text("080-1").alias("shop_phone"),
            text("₹").alias("currency"), text(None).alias("upi_id"), text("91").alias("country_code"), text("Thank you! Visit again.").alias("receipt_footer"),
            F.lit(True).alias("hide_out_of_stock"), text("Fresh").alias("tagline"), text(None).alias("whatsapp"), text("https://maps/1").alias("maps_url"),
            text(None).alias("cover_image_url"),
        )

    @cached_property
    def shop_hours(self) -> DataFrame:
        """Opening hours of many shops as the JSON their owners typed, mistakes included."""
        k = F.col("c_custkey")
        day = lambda name, text: F.concat(F.lit(f'"{name}":'), text)
        span = lambda a, b: F.concat(F.lit('{"closed":false,"open":"'), a, F.lit('","close":"'), b, F.lit('"}'))
        hour = lambda base, step: F.concat(F.lpad((F.lit(base) + k % step).cast("string"), 2, "0"), F.lit(":30"))
        bad = F.when(k % 17 == 0, F.lit("7:00")).otherwise(hour(6, 4))
        same = F.when(k % 19 == 0, hour(9, 3)).otherwise(hour(20, 4))
        return self.raw("customer").select(
            k.alias("shop_id"),
            F.concat(
                F.lit("{"),
                F.concat_ws(
                    ",",
                    day("mon", span(bad, hour(21, 2))),
                    day("tue", F.lit('{"closed":true}')),
                    F.when(k % 2 == 0, day("wed", span(hour(9, 3), same))),
                    F.when(k % 3 == 0, day("fri", span(hour(17, 2), F.lit("02:00")))),
                    day("sat", span(F.lit("18:00"), F.lit("03:15"))),
                ),
                F.lit("}"),
            ).alias("opening_hours"),
        )
