"""Batch maintenance of the shop's own tables.

Edits arrive as staged rows ``(seq, id, is_new, ...)``: a validated batch is merged
over the current table with one full outer join. Where the table format has MERGE,
the accepted rows are its source.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions import clean, messages
from tillworks.functions import timeutil as T
from tillworks.operators import diff as D
from tillworks.sources import payloads


def merge_recipe_lines(lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Repeated ingredients of a recipe summed, unknown ingredients dropped."""
    merged = lines.groupBy("menu_item_id", "ingredient_id").agg(F.sum("qty").cast("decimal(12,3)").alias("qty"))
    known = ingredients.select(F.col("id").alias("ingredient_id"))
    return merged.join(known, "ingredient_id", "left_semi").select("menu_item_id", "ingredient_id", "qty")


def recipe_map(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Per menu item its recipe as an array ordered by ingredient name."""
    part = ingredients.select(F.col("id").alias("ingredient_id"), "name", "unit")
    entry = F.struct(F.lower("name").alias("key"), "ingredient_id", "name", "unit", "qty")
    packed = recipes.join(part, "ingredient_id").groupBy("menu_item_id").agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    plain = lambda e: F.struct(e["ingredient_id"].alias("ingredient_id"), e["name"].alias("name"), e["unit"].alias("unit"), e["qty"].alias("qty"))
    return packed.select("menu_item_id", F.transform("_r", plain).alias("recipe"))


# ---- staged edits ---------------------------------------------------------


def latest_edit(staged: DataFrame) -> DataFrame:
    """The last staged row per id, by an aggregate that combines map-side."""
    rest = [c for c in staged.columns if c != "id"]
    return staged.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


def duplicate_keys(current: DataFrame, staged: DataFrame, key: Column) -> DataFrame:
    """Ids of staged rows whose key another row holds: a current row, or an earlier staged one.

    A current row that is itself being edited no longer holds its old key.
    """
    held = current.join(staged.select("id"), "id", "left_anti").select(key.alias("_k"), "id", F.lit(-1).cast("bigint").alias("seq"))
    wanted = staged.select(key.alias("_k"), "id", "seq")
    owner = held.unionByName(wanted).groupBy("_k").agg(F.min_by("id", F.struct("seq", "id")).alias("_owner"))
    return wanted.join(owner, "_k").filter(F.col("_owner") != F.col("id")).select("id")


def with_errors(staged: DataFrame, current: DataFrame, rules: list[tuple[Column, str]], missing: str, key: Column | None = None, taken: Column | None = None) -> DataFrame:
    """Adds ``error``: the first broken rule, an update of an unknown id, or a key already taken."""
    known = current.select("id", F.lit(True).alias("_known"))
    rows = staged.join(known, "id", "left").withColumn("error", clean.first_violation(*rules, (~F.col("is_new") & F.col("_known").isNull(), missing))).drop("_known")
    if key is None:
        return rows
    clashes = duplicate_keys(current, rows.filter("error is null"), key).withColumn("_clash", F.lit(True))
    rows = rows.join(clashes, "id", "left")
    return rows.withColumn("error", F.when(F.col("error").isNull() & F.col("_clash"), taken).otherwise(F.col("error"))).drop("_clash")


def apply_edits(current: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """The merged table with ``outcome`` and ``changes`` per row; refused edits follow with their error.

    ``columns`` are the editable columns both sides share. Other columns of the
    current table are kept.
    """
    ok = edits.filter("error is null").select("id", F.struct(*columns).alias("_new"))
    old = current.select("*", F.struct(*columns).alias("_old"))
    rows = old.join(ok, "id", "full_outer")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c)
    opts = {"ignoreNullFields": "false"}
    same = F.to_json("_old", opts) == F.to_json("_new", opts)
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").when(same, "unchanged").otherwise("updated")
    delta = D.changes_json(D.json_diff(F.to_json("_old", opts), F.to_json("_new", opts)))
    merged = rows.withColumn("outcome", outcome).withColumn("changes", F.when(F.col("outcome") == "updated", delta))
    merged = merged.select("id", *[pick(c) for c in columns], "outcome", "changes")
    refused = edits.filter("error is not null").select("id", *[F.lit(None).cast(t).alias(c) for c, t in merged.select(*columns).dtypes], F.col("error").alias("outcome"), F.lit(None).cast("string").alias("changes"))
    return merged.unionByName(refused)


def edit_audit(applied: DataFrame, entity: str, columns: list[str], label: str, label_key: str = "name", signed_out: DataFrame | None = None) -> DataFrame:
    """Audit rows of applied edits: created rows keep their snapshot, updated ones their label and the changed fields.

    ``signed_out``: (id, sessions) that an update ended; given, updates name the count, 0 where there is none.
    """
    rows = applied.filter("outcome in ('created', 'updated')")
    quoted = F.regexp_replace(F.to_json(F.array(label)), r"^\[|\]$", "")
    tail = F.lit("}")
    if signed_out is not None:
        rows = rows.join(signed_out, "id", "left")
        tail = F.concat(F.lit(',"sessions_signed_out":'), F.coalesce("sessions", F.lit(0)).cast("string"), F.lit("}"))
    updated = F.concat(F.lit(f'{{"{label_key}":'), quoted, F.lit(',"changes":'), F.col("changes"), tail)
    # A snapshot names the row under the label's key, whatever its column is called.
    fields = [F.col(c) for c in columns] + ([] if label_key in columns else [F.col(label).alias(label_key)])
    created = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    verb = F.when(F.col("outcome") == "created", "create").otherwise("update")
    return rows.select(
        F.col("id").cast("string").alias("entity_id"), F.concat(F.lit(f"{entity}."), verb).alias("action"), F.when(verb == "create", created).otherwise(updated).alias("details")
    )


def sessions_ended(sessions: DataFrame, left: DataFrame) -> DataFrame:
    """(id, sessions): how many sessions of each account are gone, ``left`` being those that remain."""
    return sessions.join(left.select("id"), "id", "left_anti").groupBy(F.col("admin_id").alias("id")).agg(F.count("*").alias("sessions"))


def recipe_audit(changed: DataFrame) -> DataFrame:
    """Audit rows of replaced recipes (see :func:`replace_recipes`) with both recipes as lists."""
    name = F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", "")
    details = F.concat(F.lit('{"name":'), name, F.lit(',"from":'), F.col("before"), F.lit(',"to":'), F.col("after"), F.lit("}"))
    return changed.select(F.col("menu_item_id").cast("string").alias("entity_id"), F.lit("menu.recipe").alias("action"), details.alias("details"))


MENU_COLUMNS = ["name", "category", "price", "is_active", "image_url"]


def menu_edits(staged: DataFrame, menu: DataFrame) -> DataFrame:
    rows = latest_edit(staged).select(
        "id", "seq", "is_new", clean.blank_to_null(F.col("name")).alias("name"), clean.category_or_default(F.col("category")).alias("category"),
        "price", F.coalesce("is_active", F.lit(True)).alias("is_active"), clean.blank_to_null(F.col("image_url")).alias("image_url"),
    )
    rules = [
        (F.col("name").isNull(), messages.NO_NAME),
        (~F.col("image_url").rlike(clean.URL_PATTERN), messages.BAD_IMAGE_URL),
    ]
    return with_errors(rows, menu, rules, messages.NO_MENU_ITEM)


INGREDIENT_COLUMNS = ["name", "unit"]


def ingredient_edits(staged: DataFrame, ingredients: DataFrame) -> DataFrame:
    rows = latest_edit(staged).withColumn("name", clean.blank_to_null(F.col("name")))
    rules = [
        (F.col("name").isNull(), messages.NO_NAME),
        (~F.coalesce(F.col("unit").isin(*clean.UNITS), F.lit(False)), messages.BAD_UNIT),
    ]
    return with_errors(rows, ingredients, rules, messages.NO_INGREDIENT, F.lower("name"), messages.ingredient_taken(F.col("name")))


STOCK_SETTING_COLUMNS = ["track_stock", "low_stock_at"]


def stock_setting_edits(staged: DataFrame, ingredients: DataFrame) -> DataFrame:
    rows = latest_edit(staged).withColumn("track_stock", F.coalesce("track_stock", F.lit(False)))
    level = F.col("low_stock_at")
    return with_errors(rows, ingredients, [((level < 0) | (level > 1_000_000_000), messages.BAD_ALERT)], messages.NO_INGREDIENT)


STAFF_COLUMNS = ["username", "role", "is_active", "login_from", "login_to", "auto_approve"]


def staff_edits(staged: DataFrame, admins: DataFrame) -> DataFrame:
    """Usernames are keys in lower case; both or neither login hour; super accounts are never gated."""
    rows = latest_edit(staged).select(
        "id", "seq", "is_new", clean.username_key(F.col("username")).alias("username"), F.coalesce("role", F.lit("admin")).alias("role"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"), clean.blank_to_null(F.col("login_from")).alias("login_from"),
        clean.blank_to_null(F.col("login_to")).alias("login_to"), F.coalesce("auto_approve", F.lit(False)).alias("auto_approve"),
    )
    rules = [
        (~F.col("username").rlike(clean.USERNAME_PATTERN), messages.BAD_USERNAME),
        (~F.col("role").isin(*clean.ROLES), messages.BAD_ROLE),
        (F.col("login_from").isNull() != F.col("login_to").isNull(), messages.HALF_WINDOW),
    ]
    checked = with_errors(rows, admins, rules, messages.NO_USER, F.lower("username"), messages.username_taken(F.col("username")))
    is_super = F.col("role") == "super"
    for c in ("login_from", "login_to"):
        checked = checked.withColumn(c, F.when(~is_super, F.col(c)))
    return checked.withColumn("auto_approve", is_super | F.col("auto_approve"))


def sessions_after_staff_edits(sessions: DataFrame, admins: DataFrame, edits: DataFrame) -> DataFrame:
    """Sessions left after a role change or a deactivation signs the account out."""
    new = edits.filter("error is null").select("id", F.col("role").alias("_role"), F.col("is_active").alias("_active"))
    hit = admins.join(new, "id").filter((F.col("role") != F.col("_role")) | (F.col("is_active") & ~F.col("_active")))
    return sessions.join(hit.select(F.col("id").alias("admin_id")), "admin_id", "left_anti")


COUPON_COLUMNS = [
    "code", "description", "kind", "value", "max_discount", "min_bill", "buy_qty", "get_qty", "applies_to", "item_ids", "categories",
    "valid_from", "valid_to", "usage_limit", "per_customer_limit", "is_active",
]
COUPON_PAYLOAD = (
    "code string, description string, kind string, value string, max_discount string, min_bill string, buy_qty string, get_qty string, "
    "applies_to string, item_ids string, categories string, valid_from string, valid_to string, usage_limit string, "
    "per_customer_limit string, is_active boolean"
)


#: Fields of a coupon payload that are given as text and read as numbers or days.
COUPON_NUMBERS = {
    "value": "decimal(10,2)", "max_discount": "decimal(10,2)", "min_bill": "decimal(10,2)", "buy_qty": "int", "get_qty": "int",
    "valid_from": "date", "valid_to": "date", "usage_limit": "int", "per_customer_limit": "int",
}


def coupon_edits(staged: DataFrame, coupons: DataFrame) -> DataFrame:
    """Coupon payloads ``(seq, id, is_new, payload)`` normalised and checked."""
    p = latest_edit(staged).select("id", "seq", "is_new", F.from_json("payload", COUPON_PAYLOAD).alias("p"))
    raw = lambda c: F.col(f"p.{c}")
    num = lambda c, t: F.nullif(raw(c), F.lit("")).try_cast(t)
    kind = F.lower(F.trim(F.coalesce(raw("kind"), F.lit(""))))
    scope = F.coalesce(clean.blank_to_null(F.lower(raw("applies_to"))), F.lit("all"))
    bogo, whole = kind == "bogo", scope == "all"
    empty_ids, empty_texts = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    rows = p.select(
        "id", "seq", "is_new",
        clean.coupon_code_key(raw("code")).alias("code"),
        clean.blank_to_null(raw("description")).alias("description"),
        kind.alias("kind"),
        F.when(bogo, F.lit(0)).otherwise(F.coalesce(num("value", "decimal(10,2)"), F.lit(0))).cast("decimal(10,2)").alias("value"),
        F.when(kind != "flat", num("max_discount", "decimal(10,2)")).alias("max_discount"),
        F.coalesce(num("min_bill", "decimal(10,2)"), F.lit(0)).cast("decimal(10,2)").alias("min_bill"),
        F.when(bogo, num("buy_qty", "int")).alias("buy_qty"),
        F.when(bogo, num("get_qty", "int")).alias("get_qty"),
        scope.alias("applies_to"),
        F.when(whole, empty_ids).otherwise(payloads.id_list(raw("item_ids"))).alias("item_ids"),
        F.when(whole, empty_texts).otherwise(payloads.text_list(raw("categories"))).alias("categories"),
        num("valid_from", "date").alias("valid_from"),
        num("valid_to", "date").alias("valid_to"),
        num("usage_limit", "int").alias("usage_limit"),
        num("per_customer_limit", "int").alias("per_customer_limit"),
        F.coalesce(raw("is_active"), F.lit(True)).alias("is_active"),
        reduce(or_, [F.nullif(raw(n), F.lit("")).isNotNull() & num(n, t).isNull() for n, t in COUPON_NUMBERS.items()]).alias("malformed"),
    )
    c = F.col
    rules = [
        (~c("code").rlike(clean.COUPON_CODE_PATTERN), messages.BAD_CODE),
        (~c("kind").isin(*clean.COUPON_KINDS), messages.BAD_COUPON_KIND),
        (c("malformed"), messages.BAD_COUPON_NUMBER),
        ((c("kind") == "percent") & ((c("value") <= 0) | (c("value") > 100)), messages.BAD_PERCENT),
        ((c("kind") == "flat") & (c("value") <= 0), messages.BAD_FLAT),
        ((c("kind") == "bogo") & ((F.coalesce(c("buy_qty"), F.lit(0)) < 1) | (F.coalesce(c("get_qty"), F.lit(0)) < 1)), messages.BAD_BOGO),
        (c("max_discount") <= 0, messages.BAD_CAP),
        (c("min_bill") < 0, messages.BAD_MIN_BILL),
        (~c("applies_to").isin("all", "items"), messages.BAD_SCOPE),
        ((c("applies_to") == "items") & (F.size("item_ids") == 0) & (F.size("categories") == 0), messages.EMPTY_SCOPE),
        (c("valid_to") < c("valid_from"), messages.BAD_VALIDITY),
        (c("usage_limit") < 1, messages.BAD_TOTAL_USES),
        (c("per_customer_limit") < 1, messages.BAD_CUSTOMER_USES),
    ]
    return with_errors(rows, coupons, rules, messages.NO_COUPON, F.upper("code"), messages.code_taken(F.col("code"))).drop("malformed")


def replace_recipes(recipes: DataFrame, payloads_in: DataFrame, menu: DataFrame, ingredients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the recipes of the items whose payload is valid.

    Returns the new recipe table and one row per item whose recipe text changed.
    """
    known = menu.select(F.col("id").alias("menu_item_id"), "name")
    edited = payloads_in.join(known, "menu_item_id").filter(payloads.recipe_payload_error(F.col("items")).isNull())
    fresh = merge_recipe_lines(payloads.explode_recipe_items(edited.select("menu_item_id", "items")), ingredients)
    touched = edited.select("menu_item_id", "name")
    table = recipes.join(touched.select("menu_item_id"), "menu_item_id", "left_anti").unionByName(fresh)
    text = lambda df, name: recipe_map(df, ingredients).select("menu_item_id", F.to_json("recipe").alias(name))
    before = text(recipes.join(touched, "menu_item_id", "left_semi"), "before")
    compared = touched.join(before, "menu_item_id", "left").join(text(fresh, "after"), "menu_item_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("[]")).alias(c)
    changed = compared.select("menu_item_id", "name", blank("before"), blank("after")).filter("before <> after")
    return table, changed


# ---- settings -------------------------------------------------------------

SETTINGS_COLUMNS = [
    "shop_name", "shop_address", "shop_phone", "currency", "upi_id", "country_code", "receipt_footer", "hide_out_of_stock",
    "tagline", "whatsapp", "maps_url", "cover_image_url",
]


def patch_settings(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Settings of many shops patched from JSON ``(id, patch)``.

    The core keys are always overwritten; the home-page keys and the stock flag only
    when the patch names them. Adds ``error``; a refused patch leaves the row as it was.
    """
    rows = current.join(patches.select("id", F.from_json("patch", "map<string,string>").alias("p")), "id")
    value = lambda k: clean.blank_to_null(F.col("p")[k])
    named = lambda k, new, old: F.when(F.map_contains_key("p", k), new).otherwise(F.col(old))
    fresh = {
        "shop_name": value("shop_name"),
        "shop_address": value("shop_address"),
        "shop_phone": value("shop_phone"),
        "currency": value("currency"),
        "upi_id": value("upi_id"),
        "country_code": F.coalesce(clean.digits(F.col("p")["country_code"]), F.lit("91")),
        "receipt_footer": F.coalesce(value("receipt_footer"), F.lit(messages.DEFAULT_FOOTER)),
        "hide_out_of_stock": F.when(F.col("p")["hide_out_of_stock"].isin("true", "false"), F.col("p")["hide_out_of_stock"] == "true").otherwise(F.col("hide_out_of_stock")),
        "tagline": named("tagline", value("tagline"), "tagline"),
        "whatsapp": named("whatsapp", clean.digits(F.col("p")["whatsapp"]), "whatsapp"),
        "maps_url": named("maps_url", value("maps_url"), "maps_url"),
        "cover_image_url": named("cover_image_url", value("cover_image_url"), "cover_image_url"),
    }
    n = {k: F.col(f"_n.{k}") for k in fresh}
    rows = rows.withColumn("_n", F.struct(*[v.alias(k) for k, v in fresh.items()]))
    long = clean.longer_than
    bad_url = lambda c: ~c.rlike(clean.URL_PATTERN) | long(c, 500)
    error = clean.first_violation(
        (n["shop_name"].isNull(), messages.NO_SHOP_NAME),
        (long(n["shop_name"], 80), messages.LONG_SHOP_NAME),
        (n["currency"].isNull() | long(n["currency"], 5), messages.BAD_CURRENCY),
        (~n["upi_id"].rlike(clean.UPI_PATTERN), messages.BAD_UPI),
        (long(n["country_code"], 4), messages.BAD_COUNTRY_CODE),
        (long(n["shop_address"], 200) | long(n["receipt_footer"], 200), messages.LONG_ADDRESS),
        (long(n["shop_phone"], 20), messages.LONG_SHOP_PHONE),
        (long(n["tagline"], 120), messages.LONG_TAGLINE),
        (~n["whatsapp"].rlike(clean.WHATSAPP_PATTERN), messages.BAD_WHATSAPP),
        (bad_url(n["maps_url"]), messages.BAD_MAPS_URL),
        (bad_url(n["cover_image_url"]), messages.BAD_COVER_URL),
    )
    rows = rows.withColumn("error", error)
    opts = {"ignoreNullFields": "false"}
    old_json, new_json = F.to_json(F.struct(*SETTINGS_COLUMNS), opts), F.to_json("_n", opts)
    changes = F.when(F.col("error").isNull() & (old_json != new_json), D.changes_json(D.json_diff(old_json, new_json)))
    rows = rows.withColumn("changes", changes)
    final = [F.when(F.col("error").isNull(), n[k]).otherwise(F.col(k)).alias(k) for k in SETTINGS_COLUMNS]
    return rows.select("id", *final, "error", "changes")


# ---- deletes, purges, backfills, constraints ------------------------------


def without(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: child rows of deleted parents go."""
    return child.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def orphaned(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Set null: child rows of deleted parents stay and lose the reference."""
    hit = gone.select(F.col("id").alias("_gone")).distinct()
    return child.join(hit, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def delete_snapshots(table: DataFrame, gone: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """Audit rows keeping what was deleted."""
    rows = table.join(gone.select("id"), "id", "left_semi")
    return rows.select(F.col("id").cast("string").alias("entity_id"), F.lit(f"{entity}.delete").alias("action"), D.as_json(columns).alias("details"))


def delete_requests(requests: DataFrame, table: DataFrame, missing: str) -> DataFrame:
    """Requested ids (repeats count once) with ``error`` where the table has no such row."""
    known = table.select("id", F.lit(True).alias("_known"))
    rows = requests.select("id").distinct().join(known, "id", "left")
    return rows.select("id", F.when(F.col("_known").isNull(), F.lit(missing)).alias("error"))


def order_snapshots(gone: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Audit rows of deleted bills with what was on them; ``lines`` are the numbered lines of those bills."""
    entry = F.struct("line_no", F.col("item_name").alias("name"), "qty", "price")
    items = lines.groupBy(F.col("order_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("_lines"))
    plain = lambda e: F.struct(e["name"].alias("name"), e["qty"].alias("qty"), e["price"].alias("price"))
    rows = orders.join(gone.select("id"), "id", "left_semi").join(items, "id", "left")
    empty = F.array().cast("array<struct<name:string,qty:int,price:decimal(10,2)>>")
    rows = rows.withColumn("items", F.coalesce(F.transform("_lines", plain), empty))
    details = D.as_json(["id", "phone", "customer_name", "total", "payment_status", "items"])
    return rows.select(F.col("id").cast("string").alias("entity_id"), F.lit("order.delete").alias("action"), details.alias("details"))


def ingredient_snapshots(gone: DataFrame, ingredients: DataFrame, recipes: DataFrame) -> DataFrame:
    """Audit rows of deleted ingredients with the number of recipes each was part of."""
    used = recipes.groupBy(F.col("ingredient_id").alias("id")).agg(F.count("*").alias("used_in"))
    rows = ingredients.join(gone.select("id"), "id", "left_semi").join(used, "id", "left").withColumn("used_in", F.coalesce("used_in", F.lit(0)))
    return rows.select(F.col("id").cast("string").alias("entity_id"), F.lit("ingredient.delete").alias("action"), D.as_json(["name", "unit", "used_in"]).alias("details"))


def rekey_customers(customers: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers under their new numbers, and the moves made.

    ``moves`` is (phone, new_phone), one a phone. A move needs a customer, a valid new number, and one that no customer
    holds or asks for as well: of several moves to one number the smallest old number goes first.
    """
    known = customers.select("phone")
    free = moves.filter(F.col("new_phone").rlike(clean.PHONE_PATTERN)).join(known, "phone", "left_semi").join(known.withColumnRenamed("phone", "new_phone"), "new_phone", "left_anti")
    made = free.groupBy("new_phone").agg(F.min("phone").alias("phone"))
    return rekey_phones(customers, made), made


def rekey_phones(orders: DataFrame, moves: DataFrame) -> DataFrame:
    """A customer's new number follows to the bills: ``moves`` is (phone, new_phone)."""
    return orders.join(moves, "phone", "left").withColumn("phone", F.coalesce("new_phone", "phone")).drop("new_phone")


def backfill_orders(orders: DataFrame, served_before) -> DataFrame:
    """Fills columns added later: paid time, subtotal, and served state of old bills."""
    paid_at = F.when(F.col("payment_status") == "paid", F.coalesce("paid_at", "created_at")).otherwise(F.col("paid_at"))
    old = F.col("created_at") < T.instant(served_before)
    return (
        orders.withColumn("paid_at", paid_at)
        .withColumn("subtotal", F.coalesce("subtotal", "total"))
        .withColumn("kitchen_status", F.when(old, F.lit("served")).otherwise(F.col("kitchen_status")))
    )


def backfill_sessions(sessions: DataFrame, approved_before) -> DataFrame:
    old = F.col("created_at") < T.instant(approved_before)
    return sessions.withColumn("approved_at", F.when(old, F.coalesce("approved_at", "created_at")).otherwise(F.col("approved_at")))


def backfill_admins(admins: DataFrame) -> DataFrame:
    return admins.withColumn("auto_approve", F.lit(True))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule of one table in one aggregate, one row per rule."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules])
    return counted.select(F.inline(pairs))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, rule: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    refs = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    lost = refs.join(parent.select("id"), "id", "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def repeated_keys(df: DataFrame, key: Column, rule: str) -> DataFrame:
    """Rows beyond the first of each key."""
    groups = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return groups.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
