from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import parse_price, parse_timestamp, parse_user_id, two_decimals
from tallyflow.functions.text import batch_id, decoded_path, file_name_of, file_stem

INF = float("inf")


def evaluate(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


PRICES = {
    "12": 12.0, " 12 ": 12.0, "+7": 7.0, "-7.5": -7.5, ".5": 0.5, "5.": 5.0, "1e5": 1e5,
    "1E-2": 0.01, "inf": INF, "-inf": -INF, "Infinity": INF, "12d": None, "12f": None,
    "nan": None, "NaN": None, "1e400": None, "-1e400": None, "1,000": None, "0x10": None,
    "$5": None, "1_000": None, "": None, " ": None, "N/A": None, "1 2": None, "e5": None,
}


def test_price(spark):
    assert dict(zip(PRICES, evaluate(spark, PRICES, parse_price(F.col("t"))))) == PRICES
    assert evaluate(spark, [None], parse_price(F.col("t"))) == [None]


def test_price_finite_only(spark):
    assert evaluate(spark, ["inf", "-Infinity", "3"], parse_price(F.col("t"), True)) == [
        None, None, 3.0,
    ]


USER_IDS = {
    "7": 7, " 7 ": 7, "7.0": 7, "1e3": 1000, "-3": -3, "9007199254740993": 9007199254740993,
    "9223372036854775807": 9223372036854775807, "7.5": None, "abc": None, "": None,
    "inf": None, "1e30": None, "7d": None, "9210000000000000000.0": 9210000000000000000,
    "9.21e18": 9210000000000000000, "9223372036854775807.0": 9223372036854775807,
    "-9223372036854775808.0": -9223372036854775808, "9223372036854775808.0": None, "1e-30": None,
}


def test_user_id(spark):
    assert dict(zip(USER_IDS, evaluate(spark, USER_IDS, parse_user_id(F.col("t"))))) == USER_IDS


def test_strict_user_id_refuses_a_fraction(spark):
    assert evaluate(spark, ["7", "x"], parse_user_id(F.col("t"), strict=True)) == [7, None]
    with pytest.raises(Exception, match="not an integer"):
        evaluate(spark, ["7.5"], parse_user_id(F.col("t"), strict=True))


TIMESTAMPS = {
    "1/2/2012": datetime(2012, 1, 2), "01/02/2012": datetime(2012, 1, 2),
    "12/31/2012 5:06": datetime(2012, 12, 31, 5, 6), "2026-01-03": datetime(2026, 1, 3),
    "2026-1-3 04:05:06": datetime(2026, 1, 3, 4, 5, 6), "2026-01-03T04:05": datetime(2026, 1, 3, 4, 5),
    "13/1/2012": None, "2/30/2012": None, "20120102": None, "2012": None, "not-a-date": None,
    "": None, "1//2012": None, "/1/2012": None, "1/2/20123": None, "1/2/2012/5": None,
    "1/2/3/2012": None, "1/2/12": None, " 1/2/2012 ": datetime(2012, 1, 2), "a/b/cdef": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamp_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = evaluate(spark, TIMESTAMPS, parse_timestamp(F.col("t")))
        # An hour the New York clock skips is still a valid text.
        skipped = evaluate(spark, ["3/11/2012 2:30"], parse_timestamp(F.col("t")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert dict(zip(TIMESTAMPS, got)) == TIMESTAMPS
    assert skipped == [datetime(2012, 3, 11, 2, 30)]


def test_timestamp_declared_format(spark):
    got = evaluate(spark, ["31.12.2012", "1/2/2012"], parse_timestamp(F.col("t"), ["dd.MM.yyyy"]))
    assert got == [datetime(2012, 12, 31), None]


def test_two_decimals(spark):
    values = [(0, 0.125), (1, 1234567.0), (2, None), (3, -0.5), (4, INF), (5, 1.005)]
    rows = spark.createDataFrame(values, "i int, v double")
    got = [r["s"] for r in rows.orderBy("i").select(two_decimals(F.col("v")).alias("s")).collect()]
    expected = ["None" if v is None else f"{v:.2f}" for _, v in values]
    assert got == expected


def test_names(spark):
    uri = ["file:/a/b%20c+d%25.x.csv"]
    assert evaluate(spark, uri, file_name_of(decoded_path(F.col("t")))) == ["b c+d%.x.csv"]
    assert evaluate(spark, ["a.b.csv", "plain"], file_stem(F.col("t"))) == ["a.b", "plain"]


def test_batch_id_is_repeatable_and_padded(spark):
    ids = evaluate(spark, ["a.csv", "a.csv", "b.csv"], batch_id(F.col("t"), F.lit(7).cast("bigint")))
    assert ids[0] == ids[1] != ids[2]
    (long,) = evaluate(spark, ["a.csv"], batch_id(F.col("t"), F.lit(123456).cast("bigint")))
    assert long.startswith("a-lote-123456-")
    assert ids[0].startswith("a-lote-0007-") and len(ids[0].rsplit("-", 1)[1]) == 8


def test_whole_text_of_a_date_counts(spark):
    texts = ["1/1/2012 " + " " * 70 + "junk", "1/1/2012 10:00:00", "1/1/2012" + " " * 90]
    found = evaluate(spark, texts, parse_timestamp(F.col("t")))
    assert found == [None, datetime(2012, 1, 1, 10), datetime(2012, 1, 1)]
