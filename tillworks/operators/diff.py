"""Snapshot comparison and audit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions import labels


def fields(json: Column) -> Column:
    """Top-level fields of a JSON object as a map of canonical JSON texts.

    Canonical means sorted keys and plain numbers, so equal values have equal text; a
    field holding JSON null is kept as the text ``null`` and differs from a missing one.
    """
    parsed = F.from_json(F.coalesce(json, F.lit("{}")), "map<string,variant>")
    return F.transform_values(parsed, lambda k, v: F.to_json(v))


def key_union(a: Column, b: Column) -> Column:
    """Sorted union of the top-level keys of two JSON objects."""
    return F.array_sort(F.array_union(F.map_keys(fields(a)), F.map_keys(fields(b))))


def json_diff(old: Column, new: Column) -> Column:
    """Map of the fields that differ to their (old, new) texts; missing sides are null."""
    both = F.map_zip_with(fields(old), fields(new), lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def changes_json(diff: Column) -> Column:
    """A diff map as ``{"field":[old,new]}`` text, fields in name order."""
    value = lambda c: F.coalesce(c, F.lit("null"))
    pair = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":['), value(e["value"]["old"]), F.lit(","), value(e["value"]["new"]), F.lit("]"))
    entries = F.array_sort(F.map_entries(diff), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))


def as_json(columns: list[str], prefix: str = "") -> Column:
    return F.to_json(F.struct(*[F.col(prefix + c).alias(c) for c in columns]), {"ignoreNullFields": "false"})


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], entity: str, label: str) -> DataFrame:
    """Audit rows between two snapshots ``(entity_id, action, details)``.

    Created and deleted rows carry their snapshot, updated rows the changed fields;
    rows without a difference write nothing.
    """
    a = old.select(F.col(key), as_json(columns).alias("_old"), F.col(label).alias("_old_label"))
    b = new.select(F.col(key), as_json(columns).alias("_new"), F.col(label).alias("_label"))
    # Equal rows are settled by comparing the texts; only the others are parsed field by field.
    rows = a.join(b, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    rows = rows.withColumn("_diff", F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), json_diff(F.col("_old"), F.col("_new"))))
    rows = rows.filter(F.col("_diff").isNull() | (F.size("_diff") > 0))
    named = F.concat(F.lit('{"name":'), F.to_json(F.array("_label")).substr(F.lit(2), F.length(F.to_json(F.array("_label"))) - 2), F.lit(',"changes":'), changes_json(F.col("_diff")), F.lit("}"))
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("update")
    return rows.select(
        F.col(key).cast("string").alias("entity_id"),
        F.concat(F.lit(f"{entity}."), action).alias("action"),
        F.when(action == "update", named).otherwise(F.coalesce("_new", "_old")).alias("details"),
    )


def field_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The same comparison laid flat: one row per changed field of rows on both sides."""
    a = old.select(F.col(key), as_json(columns).alias("_old"))
    b = new.select(F.col(key), as_json(columns).alias("_new"))
    rows = a.join(b, key).filter(F.col("_old") != F.col("_new"))
    return rows.select(key, F.explode(json_diff(F.col("_old"), F.col("_new"))).alias("field", "pair")).select(key, "field", "pair.old", "pair.new")


def _text(v: Column) -> Column:
    """Readable text of a variant: strings bare, objects and lists as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _shown(key: Column, v: Column, currency: str) -> Column:
    text = _text(v)
    kind = F.schema_of_variant(v)
    return (
        F.when(text.isNull() | (text == "") | (text == "null"), F.lit("—"))
        .when(key.isin("price", "total"), F.concat(F.lit(currency), text))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit("yes")).otherwise(F.lit("no")))
        .otherwise(text)
    )


def _plain_number(n: Column) -> Column:
    """At most three decimals, no trailing zeros."""
    return F.regexp_replace(n.cast("decimal(24,3)").cast("string"), r"\.?0+$", "")


def _recipe_text(json: Column) -> Column:
    """A recipe as ``qty unit name, ...``; ``none`` for an empty or missing one."""
    lines = F.from_json(json, "array<struct<qty:string,unit:string,name:string>>")
    text = F.array_join(F.transform(lines, lambda r: F.concat_ws(" ", _plain_number(r["qty"]), r["unit"], r["name"])), ", ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("none"))


def _bill_text(json: Column) -> Column:
    """Bill lines as ``qty× name, ...``."""
    lines = F.from_json(json, "array<struct<qty:string,name:string>>")
    return F.coalesce(F.array_join(F.transform(lines, lambda r: F.concat(r["qty"], F.lit("× "), r["name"])), ", "), F.lit(""))


def render(audit: DataFrame, currency: str) -> DataFrame:
    """Adds ``label``, ``target`` and ``summary`` to audit rows; unknown actions pass through."""
    get = lambda name: F.get_json_object("details", f"$.{name}")
    kind = F.split_part(F.col("action"), F.lit("."), F.lit(1))
    ref = F.concat(F.lit("#"), F.col("entity_id"))
    target = (
        F.when(kind.isin("order", "kitchen"), F.concat(F.lit("Order "), ref))
        .when(kind == "settings", F.lit("Shop settings"))
        .when(kind == "shift", F.concat(F.lit("Shift "), ref, F.lit(" · "), F.coalesce(get("username"), F.lit(""))))
        .otherwise(F.coalesce(get("name"), get("username"), ref))
    )
    arrow = lambda a, b: F.concat(a, F.lit(" → "), b)
    human = lambda k: F.replace(k, F.lit("_"), F.lit(" "))
    changes = F.from_json(get("changes"), "map<string,array<variant>>")
    by_key = lambda m: F.array_sort(F.map_keys(m))
    changed = F.array_join(
        F.transform(by_key(changes), lambda k: F.when(k == "password", F.lit("password reset")).otherwise(F.concat(human(k), F.lit(": "), arrow(_shown(k, changes[k][0], currency), _shown(k, changes[k][1], currency))))), "; "
    )
    plain = F.from_json("details", "map<string,variant>")
    rest = F.filter(by_key(plain), lambda k: ~k.isin("name", "username"))
    listed = F.array_join(F.transform(rest, lambda k: F.concat(human(k), F.lit(": "), _shown(k, plain[k], currency))), " · ")
    money = lambda name: F.concat(F.lit(currency), get(name).cast("decimal(18,2)").cast("string"))
    out = get("sessions_signed_out").cast("bigint")
    signed_out = F.when(out > 0, F.concat(out.cast("string"), F.lit(" session(s) signed out")))
    lines = lambda *parts: F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in parts])
    off = get("difference").cast("decimal(12,2)")
    diff_label = labels.cash_diff_label(off)
    diff_text = F.when(diff_label == "Exact match", diff_label).otherwise(F.concat(diff_label, F.lit(" "), F.lit(currency), F.abs(off).cast("string")))
    dotted = lambda *parts: F.concat_ws(" · ", *parts)
    summary = (
        F.when(F.col("action").isin("order.status", "kitchen.status"), arrow(get("from"), get("to")))
        .when(F.col("action") == "order.paid", F.concat(labels.method_label(get("method")), F.lit(" · "), money("total")))
        .when(
            F.col("action") == "order.delete",
            lines(dotted(F.coalesce(F.nullif(get("customer_name"), F.lit("")), F.lit("Customer")), F.coalesce(get("phone"), F.lit("")), money("total"), get("payment_status")), _bill_text(get("items"))),
        )
        .when(F.col("action") == "menu.recipe", lines(F.concat(F.lit("Before: "), _recipe_text(get("from"))), F.concat(F.lit("After: "), _recipe_text(get("to")))))
        .when(
            F.col("action") == "menu.delete",
            lines(dotted(get("category"), money("price")), F.when(_recipe_text(get("recipe")) != "none", F.concat(F.lit("Recipe: "), _recipe_text(get("recipe"))))),
        )
        .when(
            F.col("action").isin("stock.purchase", "stock.waste", "stock.count"),
            lines(F.concat(arrow(_plain_number(get("before")), _plain_number(get("after"))), F.lit(" "), get("unit")), get("note")),
        )
        .when(F.col("action") == "shift.open", F.concat(F.lit("Opening cash "), money("opening_cash")))
        .when(
            F.col("action") == "shift.close",
            F.concat(F.lit("Expected "), money("expected_cash"), F.lit(" · counted "), money("counted_cash"), F.lit(" · "), diff_text),
        )
        .when(F.col("action") == "staff.sign_out", F.concat(get("sessions"), F.lit(" session(s) signed out")))
        .when(F.col("action") == "staff.password", F.coalesce(signed_out, F.lit("")))
        .when(get("changes").isNotNull(), lines(changed, signed_out))
        .otherwise(listed)
    )
    return audit.select("*", labels.action_label(F.col("action")).alias("label"), target.alias("target"), summary.alias("summary"))
