"""The messages a refused input gets. Their text is part of the results."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD_RANGE = "End date must be on or after start date."
LONG_RANGE = "Choose a range of up to 1 year."
BAD_PHONE = "Enter a valid 10-digit phone number, or leave it blank."
BAD_METHOD = "Choose a valid payment method."
NO_ITEMS = "Add at least one item."
BAD_BILL_LINE = "An item number or quantity of the bill cannot be read."
NO_VALID_ITEMS = "No valid items in order."
BAD_RECIPE_LIST = "Invalid ingredients list."
BAD_RECIPE_LINE = "Each ingredient needs a quantity greater than 0."
NO_ORDER = "Order not found."
NOT_PENDING = "Only pending orders can be marked as paid."
BAD_STATUS = "Choose a valid status: paid, pending or cancelled."
BAD_STOCK_KIND = "Choose purchase, waste or count."
LONG_NOTE = "Note can be at most 200 characters."
BAD_OPENING_CASH = "Enter the opening cash in the drawer (0 or more)."
BAD_COUNTED_CASH = "Enter the cash counted in the drawer (0 or more)."
OPEN_ALREADY = "You already have an open shift."
NONE_OPEN = "You have no open shift."
NO_SHIFT = "Shift not found."
SHIFT_CLOSED = "This shift is already closed."
SUPER_ONLY = "Super admin access required."
BAD_COUNT = "Enter the counted quantity (0 or more)."
BAD_QUANTITY = "Enter a quantity greater than 0."
BAD_ALERT = "Low stock alert must be 0 or more."
NO_NAME = "Name is required."
BAD_IMAGE_URL = "Image URL must start with http:// or https://"
NO_MENU_ITEM = "Menu item not found."
BAD_UNIT = "Choose a valid unit."
NO_INGREDIENT = "Ingredient not found."
BAD_USERNAME = "Username must be 3-32 characters: letters, numbers, dot, dash or underscore."
BAD_ROLE = "Choose a valid role."
HALF_WINDOW = "Set both a start and an end time for the login hours, or leave both blank."
NO_USER = "User not found."
BAD_CODE = "Code must be 3 to 20 letters, numbers, - or _."
BAD_COUPON_KIND = "Choose a coupon type."
BAD_PERCENT = "Percentage must be more than 0 and at most 100."
BAD_FLAT = "Discount amount must be more than 0."
BAD_BOGO = "Buy and free quantities must both be at least 1."
BAD_COUPON_NUMBER = "A number or date of the coupon cannot be read."
BAD_CAP = "Maximum discount must be more than 0."
BAD_MIN_BILL = "Minimum bill cannot be negative."
BAD_SCOPE = "Choose what the coupon applies to."
EMPTY_SCOPE = "Pick at least one item or category for this coupon."
BAD_VALIDITY = "Valid until must be on or after valid from."
BAD_TOTAL_USES = "Total uses must be at least 1, or blank."
BAD_CUSTOMER_USES = "Uses per customer must be at least 1, or blank."
NO_COUPON = "Coupon not found."
NO_SHOP_NAME = "Shop name is required."
LONG_SHOP_NAME = "Shop name can be at most 80 characters."
BAD_CURRENCY = "Currency symbol must be 1-5 characters."
BAD_UPI = "Enter a valid UPI ID, e.g. myshop@okaxis."
BAD_COUNTRY_CODE = "Country code must be 1-4 digits."
LONG_ADDRESS = "Address and receipt footer can be at most 200 characters."
LONG_SHOP_PHONE = "Shop phone can be at most 20 characters."
LONG_TAGLINE = "Tagline can be at most 120 characters."
BAD_WHATSAPP = "Enter a valid WhatsApp number (10-15 digits)."
BAD_MAPS_URL = "Google Maps link must start with https://"
BAD_COVER_URL = "Cover photo URL must start with https://"
DEFAULT_FOOTER = "Thank you! Visit again."


def missing_times(day: str) -> str:
    return f"Enter opening and closing times for {day} as HH:MM, or mark it closed."


def equal_times(day: str) -> str:
    return f"Opening and closing times for {day} cannot be the same."


def _named(before: str, name: Column, after: str) -> Column:
    return F.concat(F.lit(before), F.coalesce(name, F.lit("")), F.lit(after))


def ingredient_taken(name: Column) -> Column:
    return _named('An ingredient named "', name, '" already exists.')


def username_taken(name: Column) -> Column:
    return _named('Username "', name, '" is already taken.')


def code_taken(code: Column) -> Column:
    return _named("Coupon code ", code, " already exists.")


def coupon_refusal(reason: Column, code: Column, coupon: Column, currency: str) -> Column:
    """The sentence a cashier reads for a short reason; ``coupon`` is the coupon's row, null where there is none."""
    day = lambda c: F.date_format(coupon[c], "dd MMM yyyy")
    whole = lambda c: c.cast("string")
    say = lambda *parts: F.concat(F.lit("Coupon "), code, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    again = F.concat(F.lit("This customer has already used coupon "), code)
    limit = coupon["per_customer_limit"]
    return (
        F.when(reason == "no code", "Enter a coupon code.")
        .when(reason == "unknown", say(" does not exist."))
        .when(reason == "off", say(" is switched off."))
        .when(reason == "not started", say(" can be used from ", day("valid_from"), "."))
        .when(reason == "expired", say(" expired on ", day("valid_to"), "."))
        .when(reason == "below minimum", say(f" needs a bill of at least {currency}", whole(coupon["min_bill"].cast("decimal(12,2)")), "."))
        .when(reason == "nothing covered", say(" does not cover any item in this bill."))
        .when(reason == "used up", say(" has been used up."))
        .when(reason == "needs phone", say(" needs the customer's phone number. Go back and enter it."))
        .when((reason == "customer limit") & (limit == 1), F.concat(again, F.lit(".")))
        .when(reason == "customer limit", F.concat(again, F.lit(" "), whole(limit), F.lit(" times.")))
        .when(
            reason == "too few items",
            say(" needs ", whole(coupon["buy_qty"] + coupon["get_qty"]), " eligible items in the bill (buy ", whole(coupon["buy_qty"]), ", get ", whole(coupon["get_qty"]), " free)."),
        )
    )


def short_stock(name: Column, left: Column, unit: Column, need: Column) -> Column:
    """Refusal of a bill for want of an ingredient; amounts in thousandths, shown without trailing zeros."""
    shown = lambda c: F.regexp_replace((c / 1000).cast("decimal(24,3)").cast("string"), r"\.?0+$", "")
    return F.concat(F.lit("Not enough "), name, F.lit(": "), shown(left), F.lit(" "), unit, F.lit(" left, this bill needs "), shown(need), F.lit(" "), unit, F.lit("."))
