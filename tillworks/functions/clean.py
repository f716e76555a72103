"""Input normalisation and declarative validation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYMENT_METHODS = ("cash", "upi", "card")
PAYMENT_STATUSES = ("paid", "pending", "cancelled")
KITCHEN_STATUSES = ("new", "preparing", "ready", "served")
UNITS = ("g", "kg", "ml", "l", "pcs")
ROLES = ("super", "admin")
COUPON_KINDS = ("percent", "flat", "bogo")

# Fixed formats: these must equal the values the shop's data is held to.
PHONE_PATTERN = "^[0-9]{10}$"
USERNAME_PATTERN = "^[a-z0-9._-]{3,32}$"
COUPON_CODE_PATTERN = "^[A-Z0-9_-]{3,20}$"
UPI_PATTERN = "^[A-Za-z0-9._-]{2,}@[A-Za-z0-9]{2,}$"
WHATSAPP_PATTERN = "^[0-9]{10,15}$"
URL_PATTERN = "(?i)^https?://"
TIME_PATTERN = "^([01][0-9]|2[0-3]):[0-5][0-9]$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def digits(c: Column) -> Column:
    """Only the digits of a text; null when none is left."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))


def phone_ok(phone: Column) -> Column:
    """A phone may be missing, but one that is given has ten digits."""
    return phone.isNull() | phone.rlike(PHONE_PATTERN)


def lookup_phone_ok(phone: Column) -> Column:
    """History lookups want at least six digits."""
    return F.coalesce(F.length(phone) >= 6, F.lit(False))


def category_or_default(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("General"))


def payment_method(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("cash"))))


def username_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def coupon_code_key(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def longer_than(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) > n


def violations(*rules: tuple[Column, str]) -> Column:
    """Messages of the broken rules, in rule order. A null test counts as not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]))


def first_violation(*rules: tuple[Column, str]) -> Column:
    """Message of the first broken rule, null when all hold."""
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules])


def like_any(term: str) -> str:
    """Contains-pattern for a search box; ``%`` and ``_`` typed by the user stay wildcards."""
    return "%" + term.replace("\\", "\\\\") + "%"


def client_ip(headers_json: Column) -> Column:
    """First address of the forwarded-for header in a JSON header blob."""
    forwarded = F.coalesce(F.get_json_object(headers_json, "$.x-forwarded-for"), F.lit(""))
    return blank_to_null(F.split_part(forwarded, F.lit(","), F.lit(1)))
