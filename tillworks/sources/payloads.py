"""Readers for the JSON request payloads of bills, recipes and coupons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions import messages

#: Types of a line's fields; each is read as text first, so quoted numbers count and a malformed one is null.
BILL_LINE = {"menu_item_id": "bigint", "qty": "int"}
RECIPE_LINE = {"ingredient_id": "bigint", "qty": "decimal(12,3)"}


def _lines(json: Column, line: dict[str, str]) -> Column:
    """The lines of a JSON array, null if it is none."""
    texts = F.from_json(json, f"array<struct<{','.join(f'{n}:string' for n in line)}>>")
    return F.transform(texts, lambda x: F.struct(*[F.trim(x[n]).try_cast(t).alias(n) for n, t in line.items()]))


def is_filled_array(json: Column) -> Column:
    """Whether a JSON text is an array with at least one element."""
    return F.coalesce(F.json_array_length(json) > 0, F.lit(False))


def is_array_text(json: Column) -> Column:
    return F.json_array_length(json).isNotNull()


def has_bad_line(json: Column) -> Column:
    """Whether some line of a bill names an item or a quantity that is no whole number."""
    texts = F.from_json(json, f"array<struct<{','.join(f'{n}:string' for n in BILL_LINE)}>>")
    bad = lambda x: (x["menu_item_id"].isNotNull() & F.trim(x["menu_item_id"]).try_cast("bigint").isNull()) | (x["qty"].isNotNull() & F.trim(x["qty"]).try_cast("int").isNull())
    return F.coalesce(F.exists(texts, bad), F.lit(False))


def explode_bill_items(bills: DataFrame) -> DataFrame:
    """Payload rows ``(bill_id, line_no, menu_item_id, qty)``; non-arrays and empty arrays give none."""
    items = F.when(is_filled_array(F.col("items")), _lines(F.col("items"), BILL_LINE))
    return bills.select(F.col("id").alias("bill_id"), F.posexplode(items).alias("line_no", "line")).select(
        "bill_id", F.col("line_no").cast("bigint").alias("line_no"), "line.menu_item_id", "line.qty"
    )


def explode_recipe_items(payloads: DataFrame) -> DataFrame:
    """Recipe rows of valid payloads ``(menu_item_id, ingredient_id, qty)``.

    One missing id or non-positive quantity rejects the whole payload. Repeated
    ingredients stay separate rows here.
    """
    parsed = payloads.select("menu_item_id", _lines(F.col("items"), RECIPE_LINE).alias("items"))
    bad = F.exists("items", lambda x: x["ingredient_id"].isNull() | (F.coalesce(x["qty"], F.lit(0)) <= 0))
    return parsed.filter(~F.coalesce(bad, F.lit(True))).select("menu_item_id", F.inline("items"))


def recipe_payload_error(items: Column) -> Column:
    """Why a recipe payload is rejected, null when it is fine."""
    parsed = _lines(items, RECIPE_LINE)
    bad = F.exists(parsed, lambda x: x["ingredient_id"].isNull() | (F.coalesce(x["qty"], F.lit(0)) <= 0))
    return F.when(~is_array_text(items), messages.BAD_RECIPE_LIST).when(bad, messages.BAD_RECIPE_LINE)


def id_list(json: Column) -> Column:
    """Distinct ids of a JSON list, sorted; entries that are no whole number are left out."""
    ids = F.transform(_texts(json), lambda x: F.trim(x).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def text_list(json: Column) -> Column:
    """Distinct trimmed texts of a JSON list, blanks left out, sorted."""
    trimmed = F.transform(_texts(json), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def _texts(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
