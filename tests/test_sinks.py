"""Files written by the report sinks."""

import glob
from datetime import date
from decimal import Decimal as D

from tillworks.functions.timeutil import DayRange
from tillworks.sources import sinks


def test_usage_csv(spark, run_dir):
    df = spark.createDataFrame([(date(2024, 1, 1), 'Oil "A"', "ml", D("12.500")), (date(2024, 1, 2), "Rice", "kg", D("1.000"))], "day date, name string, unit string, total decimal(14,3)")
    path = sinks.write_usage_csv(df.coalesce(1), run_dir, DayRange(date(2024, 1, 1), date(2024, 1, 2)))
    assert path.endswith("ingredient-usage_2024-01-01_to_2024-01-02.csv")
    text = open(glob.glob(f"{path}/*.csv")[0], newline="").read()
    assert text == '"Date (IST)","Ingredient","Total used","Unit"\r\n"2024-01-01","Oil ""A""","12.500","ml"\r\n"2024-01-02","Rice","1.000","kg"\r\n'


def test_append_ledger_replaces_a_repeated_batch(spark, run_dir):
    for batch in (1, 2, 2):
        sinks.append_ledger(spark.range(2), f"{run_dir}/ledger", batch)
    assert spark.read.parquet(f"{run_dir}/ledger").count() == 4


def test_report_json(spark, run_dir):
    df = spark.createDataFrame([("a", '{"x":1}')], "section string, document string")
    sinks.write_report_json(df, f"{run_dir}/doc")
    assert "".join(open(p).read() for p in glob.glob(f"{run_dir}/doc/part-*.txt")) == '{"x":1}\n'
