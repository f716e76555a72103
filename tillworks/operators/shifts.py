"""Shifts: totals of the author's bills while the shift was open, and the cash count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import clean, labels, messages
from tillworks.functions import timeutil as T
from tillworks.operators.pages import with_author

SUM = "decimal(24,2)"
METHODS = ("cash", "upi", "card")


def shift_orders(shifts: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    """Bills an author made within a shift, half-open, open shifts running to ``as_of``.

    The range test rides on an equi-join over (author, day): each shift is laid out
    over the days it spans, so the join stays a hash join and a busy author is
    split by day.
    """
    day = lambda c: F.to_date(c)
    end = F.coalesce("closed_at", T.instant(as_of))
    spans = (
        shifts.select(F.col("id").alias("shift_id"), F.col("admin_id").alias("created_by"), "opened_at", end.alias("_end"))
        .filter("opened_at < _end")
        .select("*", F.explode(F.sequence(day(F.col("opened_at")), day(F.col("_end")))).alias("_day"))
    )
    bills = orders.filter("created_by is not null").withColumn("_day", day(F.col("created_at")))
    inside = (F.col("created_at") >= F.col("opened_at")) & (F.col("created_at") < F.col("_end"))
    return bills.join(spans, ["created_by", "_day"]).filter(inside).drop("_day", "_end", "opened_at")


def shift_totals(billed: DataFrame) -> DataFrame:
    """Nine conditional sums per shift in one grouping."""
    state = lambda s: F.col("payment_status") == s
    amount = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("total"))), F.lit(0)).cast(SUM).alias(name)
    paid = state("paid")
    return billed.groupBy("shift_id").agg(
        F.count_if(paid).alias("orders"),
        amount(paid, "sales"),
        *[amount(paid & (F.col("payment_method") == m), m) for m in METHODS],
        F.count_if(state("pending")).alias("pending_count"),
        amount(state("pending"), "pending_total"),
        F.count_if(state("cancelled")).alias("cancelled_count"),
        amount(state("cancelled"), "cancelled_total"),
    )


TOTALS = ["orders", "sales", "cash", "upi", "card", "pending_count", "pending_total", "cancelled_count", "cancelled_total"]


def reconcile(shifts: DataFrame, orders: DataFrame, admins: DataFrame, as_of) -> DataFrame:
    """Every shift with its totals, expected cash, difference and label.

    Shifts that carry frozen ``totals`` (JSON) or a frozen ``expected_cash`` keep them:
    later changes to their bills do not move a closed shift. Live figures fill the rest.
    """
    live = shift_totals(shift_orders(shifts, orders, as_of)).withColumnRenamed("shift_id", "id")
    rows = shifts.join(live, "id", "left")
    kind = {c: "bigint" if c == "orders" or c.endswith("count") else SUM for c in TOTALS}
    if "totals" in shifts.columns:
        rows = rows.withColumn("_kept", F.from_json("totals", ", ".join(f"{c} {t}" for c, t in kind.items())))
    for c in TOTALS:
        kept = [F.when(F.col("totals").isNotNull(), F.coalesce(F.col("_kept")[c], F.lit(0)))] if "totals" in shifts.columns else []
        rows = rows.withColumn(c, F.coalesce(*kept, F.col(c), F.lit(0)).cast(kind[c]))
    frozen = F.col("expected_cash") if "expected_cash" in shifts.columns else F.lit(None)
    rows = rows.withColumn("expected_cash", F.coalesce(frozen, F.col("opening_cash") + F.col("cash")).cast(SUM))
    difference = F.when(F.col("closed_at").isNotNull(), F.col("counted_cash") - F.col("expected_cash")).cast(SUM)
    rows = rows.withColumn("difference", difference)
    rows = rows.withColumn("label", F.when(F.col("difference").isNotNull(), labels.cash_diff_label(F.col("difference"))))
    rows = with_author(rows, admins, "admin_id", "username")
    rows = with_author(rows, admins, "closed_by", "closed_by_name")
    return rows.select(
        "id", "username", "opened_at", "closed_at", F.col("closed_at").isNull().alias("is_open"), "closed_by_name", "opening_cash", *TOTALS,
        "expected_cash", "counted_cash", "difference", "label",
    )


# ---- opening and closing --------------------------------------------------

MAX_CASH = 10_000_000


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by account, time and id; remembers the account's open shift only. ``verdict`` names what stands in the way."""
    account, current = None, None
    for f in frames:
        verdict, shift = np.full(len(f), "", object), np.zeros(len(f), np.int64)
        columns = (f[c].tolist() for c in ("account", "id", "kind", "named", "target", "sound", "allowed"))
        for i, (who, id_, kind, named, target, sound, allowed) in enumerate(zip(*columns, strict=True)):
            if who != account:
                account, current = who, None
            if kind == "open":
                if not sound:
                    verdict[i] = "cash"
                elif current is not None:
                    verdict[i] = "open already"
                else:
                    current = id_
                    shift[i] = id_
            elif named and target != current:
                verdict[i] = "not open"
            elif current is None:
                verdict[i] = "none open"
            elif not allowed:
                verdict[i] = "super only"
            else:
                shift[i] = current
                if sound:
                    current = None
                else:
                    verdict[i] = "input"
        yield pd.DataFrame({"id": f["id"], "verdict": verdict, "shift_id": shift})


def decide_turns(requests: DataFrame, admins: DataFrame, stored: DataFrame) -> DataFrame:
    """Open and close requests with ``shift_id`` (the shift opened or closed) or ``error``.

    ``requests``: (id, admin_id, kind, cash, note, target, created_at); ``kind`` is ``open`` or ``close``, ``target`` the shift
    a close names, null for one's own. ``stored``: the shifts already there (id, admin_id, opened_at, closed_at), at most one of an
    account open; ids are distinct over both tables and the id of an open request becomes the shift's. An account has one open shift at
    a time; another's shift is closed by super accounts only. One pass reads each account's requests in time order and
    remembers one number, so an account of any size is read in constant memory.
    """
    role = admins.select(F.col("id").alias("admin_id"), F.col("role").eqNullSafe("super").alias("_super"))
    opens = requests.filter("kind = 'open'").select(F.col("id").alias("target"), F.col("admin_id").alias("_owner"))
    owners = opens.unionByName(stored.select(F.col("id").alias("target"), F.col("admin_id").alias("_owner")))
    rows = requests.join(role, "admin_id", "left").join(owners, "target", "left")
    is_open, named = F.col("kind") == "open", (F.col("kind") == "close") & F.col("target").isNotNull()
    cash_error = F.col("cash").isNull() | (F.col("cash") < 0) | (F.col("cash") > MAX_CASH)
    long_note = F.coalesce(F.length(clean.blank_to_null(F.col("note"))) > 200, F.lit(False)) & ~is_open
    rows = rows.select(
        "id", "admin_id", "kind", F.when(named, F.col("target")).alias("target"), "created_at", F.col("cash").cast("decimal(10,2)").alias("cash"),
        clean.blank_to_null(F.col("note")).alias("note"), F.when(named, F.col("_owner")).otherwise(F.col("admin_id")).alias("account"),
        F.when(cash_error, F.when(is_open, messages.BAD_OPENING_CASH).otherwise(messages.BAD_COUNTED_CASH)).when(long_note, messages.LONG_NOTE).alias("unsound"),
        (~named | F.coalesce("_super", F.lit(False)) | F.col("_owner").eqNullSafe(F.col("admin_id"))).alias("allowed"),
    )
    rows = stage_table(rows)
    started = stored.filter("closed_at is null").select(
        F.col("admin_id").alias("account"), "id", F.lit("open").alias("kind"), F.lit(None).cast("bigint").alias("target"), F.lit(True).alias("sound"), F.lit(True).alias("allowed"),
        F.col("opened_at").alias("created_at"), F.lit(0).alias("_after"),
    )
    asked = rows.filter("account is not null").select("account", "id", "kind", "target", F.col("unsound").isNull().alias("sound"), "allowed", "created_at", F.lit(1).alias("_after"))
    # Whole numbers with nulls would reach pandas as floats.
    line = started.unionByName(asked).repartition("account").sortWithinPartitions("account", "_after", "created_at", "id")
    line = line.select("account", "id", "kind", F.col("target").isNotNull().alias("named"), F.coalesce("target", F.lit(0)).alias("target"), "sound", "allowed")
    found = stage_table(line.mapInPandas(_turns, "id bigint, verdict string, shift_id bigint"))
    began = found.join(rows.filter("kind = 'open'").select("id", "created_at"), "id").filter("verdict = ''").select(F.col("id").alias("target"), F.struct("created_at", "id").alias("_began"))
    there = began.unionByName(stored.select(F.col("id").alias("target"), F.lit(None).cast(began.schema["_began"].dataType).alias("_began")))
    rows = rows.join(found, "id", "left").join(there.withColumn("_there", F.lit(True)), "target", "left")
    # A shift that starts later than the request is not there yet.
    exists = F.coalesce("_there", F.lit(False)) & (F.col("_began").isNull() | (F.col("_began") < F.struct("created_at", "id")))
    v = F.coalesce("verdict", F.lit("not open"))
    error = (
        F.when(v == "cash", F.col("unsound"))
        .when(v == "open already", messages.OPEN_ALREADY)
        .when(v == "none open", messages.NONE_OPEN)
        .when((v == "not open") & ~exists, messages.NO_SHIFT)
        .when((v == "super only") | ((v == "not open") & ~F.col("allowed")), messages.SUPER_ONLY)
        .when(v == "not open", messages.SHIFT_CLOSED)
        .when(v == "input", F.col("unsound"))
    )
    return rows.select("id", "admin_id", "kind", "target", "cash", "note", "created_at", F.when(error.isNull(), F.col("shift_id")).alias("shift_id"), error.alias("error"))


def shifts_after(decided: DataFrame, stored: DataFrame, orders: DataFrame) -> DataFrame:
    """All shifts after decided requests; those closed now carry frozen totals, expected cash and the difference.

    ``stored`` has id, admin_id, opened_at, closed_at, closed_by, opening_cash and counted_cash; of shifts closed before, the
    frozen columns stay empty here, they are those of the stored table.
    """
    done = decided.filter("error is null")
    opened = done.filter("kind = 'open'").select("id", "admin_id", F.col("created_at").alias("opened_at"), F.col("cash").alias("opening_cash"))
    closes = done.filter("kind = 'close'").select(
        F.col("shift_id").alias("id"), F.col("created_at").alias("_at"), F.col("admin_id").alias("_by"), F.col("cash").alias("_cash"), F.col("note").alias("note")
    )
    rows = stored.select("id", "admin_id", "opened_at", "opening_cash", "closed_at", "closed_by", "counted_cash").unionByName(opened, allowMissingColumns=True)
    rows = stage_table(rows.join(closes, "id", "left").withColumn("_now", F.col("_at").isNotNull()))
    for c, fresh in (("closed_at", "_at"), ("closed_by", "_by"), ("counted_cash", "_cash")):
        rows = rows.withColumn(c, F.coalesce(fresh, c))
    closed = rows.filter("_now")
    # Every one of them has an end, so the instant open shifts run to is not used.
    sums = shift_totals(shift_orders(closed, orders, "1970-01-01")).withColumnRenamed("shift_id", "id")
    sums = closed.select("id").join(sums, "id", "left")
    kind = {c: "bigint" if c == "orders" or c.endswith("count") else SUM for c in TOTALS}
    filled = [F.coalesce(c, F.lit(0)).cast(kind[c]).alias(c) for c in TOTALS]
    sums = sums.select("id", F.struct(*filled).alias("_t"))
    rows = rows.join(sums, "id", "left")
    expected = F.when(F.col("_now"), F.col("opening_cash") + F.col("_t.cash")).cast(SUM)
    return rows.select(
        "id", "admin_id", "opened_at", "closed_at", "closed_by", "opening_cash", "counted_cash", "note", expected.alias("expected_cash"),
        F.when(F.col("_now"), F.col("counted_cash") - expected).cast(SUM).alias("difference"), F.to_json("_t").alias("totals"),
    )


def turn_audit(decided: DataFrame, after: DataFrame, admins: DataFrame) -> DataFrame:
    """One audit row for each shift opened or closed."""
    done = decided.filter("error is null").select("id", "kind", "shift_id")
    shift = after.select(F.col("id").alias("shift_id"), "admin_id", "opening_cash", "expected_cash", "counted_cash", "difference")
    rows = with_author(done.join(shift, "shift_id"), admins, "admin_id", "username")
    opts = {"ignoreNullFields": "false"}
    opened = F.to_json(F.struct("username", "opening_cash"), opts)
    closed = F.to_json(F.struct("username", "opening_cash", "expected_cash", "counted_cash", "difference"), opts)
    is_open = F.col("kind") == "open"
    return rows.select("id", F.concat(F.lit("shift."), "kind").alias("action"), F.col("shift_id").cast("string").alias("entity_id"), F.when(is_open, opened).otherwise(closed).alias("details"))
