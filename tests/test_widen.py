from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from orrery.operators.widen import as_boolean, as_date, as_decimal, as_integer, as_text, widen

VALUES = [
    ("18,252.94", "18252.94", None), (" 92850.00 ", "92850.00", "92850"), ("+3503.29", "3503.29", None), ("15E2", "1500.00", "1500"), ("28300", "28300.00", "28300"),
    ("1.005", "1.01", None), ("-0.5", "-0.50", None), ("12,,x", None, None), ("1.2.3", None, None), ("1,23", None, None), ("high", None, None), ("n/a", None, None), ("", None, None), (None, None, None), ("60696.0", "60696.00", "60696"), ("7 or 8", None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in VALUES], "v string").select("v", as_decimal(F.col("v")).alias("d"), as_integer(F.col("v")).alias("i"))
    assert [tuple(r) for r in df.collect()] == VALUES


def test_other_kinds(spark):
    cases = {
        as_boolean: {" True": "true", "Y": "true", "1": "true", "FALSE ": "false", "no": "false", "maybe": None, "-": None, None: None},
        as_date: {"1984-11-30": "1984-11-30", "05.06.1976": "1976-06-05", "19910525": "1991-05-25", "1940-06-24T00:00:00": "1940-06-24", "31 Jul 1991": "1991-07-31", "4 October 1972": "1972-10-04", "30.02.1990": None, "19911350": None, "later": None, None: None},
        as_text: {" Port  Ansel ": "Port Ansel", "?": None, "NULL": None, None: None, "x" * 10_000: "x" * 10_000},
    }
    for f, want in cases.items():
        rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", f(F.col("v")).alias("r")).collect()
        assert {r["v"]: r["r"] for r in rows} == want


def test_widen(spark):
    rows = [
        (5, "City", "Old", 1), (5, " city ", "New", 2), (5, "credit-limit", "1,000.5", 1), (5, "Loyalty Points", "7.0", 1), (5, "x", "1", 1),
        (2, "is_active", "Y", 1), (2, "birth date", "01.02.2000", 1), (9, "other", None, 1), (None, "city", "lost", 1), (7, None, "lost", 1), (2, "city", "b", None), (2, "city", "a", None),
    ]
    fields = {"city": "text", "credit_limit": "decimal", "loyalty_points": "integer", "is_active": "boolean", "birth_date": "date"}
    df = spark.createDataFrame(rows, "k bigint, f string, v string, t int").withColumn("entity", F.lit("clash"))
    for size in (1, 50_000):
        got = {r["entity"]: r for r in widen(df, entity="k", field="f", value="v", order=["t"], fields=fields, range_size=size).collect()}
        assert sorted(r["ordinal"] for r in got.values()) == [0, 1, 2]
        assert tuple(got[5])[2:] == (4, "New", Decimal("1000.50"), 7, None, None)
        assert tuple(got[2])[2:] == (3, "b", None, None, True, date(2000, 2, 1))
        assert tuple(got[9])[2:] == (1, None, None, None, None, None)
    assert widen(df.limit(0), entity="k", field="f", value="v", order=["t"], fields=fields).count() == 0
