"""Sign-in window rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_of(hhmm: Column) -> Column:
    """'HH:MM' text to minutes since midnight; 'H:MM' counts too, other texts give null."""
    parts = F.substring_index(hhmm, ":", 1).try_cast("int") * 60 + F.substring_index(hhmm, ":", -1).try_cast("int")
    return F.when(hhmm.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"), parts)


def in_login_window(role: Column, login_from: Column, login_to: Column, minute: Column) -> Column:
    """Whether an account may sign in at a local minute of the day.

    Super accounts and accounts without both bounds are never gated. A window
    whose end lies before its start runs past midnight.
    """
    start, stop = minute_of(login_from), minute_of(login_to)
    ungated = (role == "super") | login_from.isNull() | login_to.isNull() | (start == stop)
    daytime = (minute >= start) & (minute < stop)
    overnight = (minute >= start) | (minute < stop)
    return F.when(ungated, F.lit(True)).when(start < stop, daytime).otherwise(overnight)


def window_label(login_from: Column, login_to: Column) -> Column:
    """'HH:MM and HH:MM', null when the account has no window."""
    return F.concat(login_from, F.lit(" and "), login_to)
