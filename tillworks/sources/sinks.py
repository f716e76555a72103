"""Report and ledger sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions.timeutil import DayRange


def write_usage_csv(usage: DataFrame, folder: str, days: DayRange) -> str:
    """Usage rows as CSV: every field quoted, quotes doubled, CRLF lines, with a header.

    Written as a folder of part files by the executors, without a byte-order mark.
    """
    path = f"{folder.rstrip('/')}/ingredient-usage_{days.first}_to_{days.last}.csv"
    titles = {"day": "Date (IST)", "name": "Ingredient", "total": "Total used", "unit": "Unit"}
    out = usage.select(*[F.col(c).alias(titles[c]) for c in ("day", "name", "total", "unit") if c in usage.columns])
    writer = out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("lineSep", "\r\n").option("emptyValue", "").csv(path)
    return path


def write_report_json(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def append_ledger(rows: DataFrame, path: str, batch_id: int | str) -> None:
    """Appends ledger rows under their batch id; writing a batch again replaces it, so retries add nothing."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
