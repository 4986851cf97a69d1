from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from orrery.functions.times import instant_us, ntz_of_us, stamp_us

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(*parts, hours=0):
    return (datetime(*parts, tzinfo=timezone(timedelta(hours=hours))) - EPOCH) // timedelta(microseconds=1)


CASES = {
    "2024-07-31T22:47:43.840": micros(2024, 7, 31, 22, 47, 43, 840000),
    "2024-07-31 22:47:43": micros(2024, 7, 31, 22, 47, 43),
    " 2024-07-31T22:47:43Z ": micros(2024, 7, 31, 22, 47, 43),
    "2024-10-19T22:09:48-05:00": micros(2024, 10, 19, 22, 9, 48, hours=-5),
    "2024-10-19T22:09:48.123456+02:00": micros(2024, 10, 19, 22, 9, 48, 123456, hours=2),
    "2024-10-19 22:09:48 +02:00": micros(2024, 10, 19, 22, 9, 48, hours=2),
    "2025/02/17 00:45:52": micros(2025, 2, 17, 0, 45, 52),
    "20240813T135526Z": micros(2024, 8, 13, 13, 55, 26),
    "2024-09-18": micros(2024, 9, 18),
    "20240918": micros(2024, 9, 18),
    "1736746615": 1736746615000000,
    "1736746615.5": 1736746615500000,
    **dict.fromkeys(["", "   ", "unknown", "N/A", "null", "2024-13-05T08:00:00", "2025-02-30", "0000-00-00 00:00:00", "2024-9", "T10:00:00", "12", None, "x" * 5000, "2024-01-01T25:00:00"]),
}


def test_notations(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", instant_us(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == CASES


def test_other_session_zone_changes_nothing(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_notations(spark)
        us = [0, -1, 1707770772999999, 253402300799000000]
        df = spark.createDataFrame([(u,) for u in us], "u bigint").select("u", stamp_us(ntz_of_us(F.col("u"))).alias("v"))
        assert all(r["u"] == r["v"] for r in df.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
