"""Row-wise transforms and column helpers, with values worked out by hand."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayrate.functions import columns, encode
from stayrate.operators.distribution import log_summary


def one(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_whole_months_until(spark):
    days = [date(2013, 6, 15), date(2016, 1, 1), date(2016, 1, 2), date(2016, 11, 8), None]
    df = spark.createDataFrame([(d,) for d in days], "d date").coalesce(1)
    assert one(df, encode.whole_months_until(date(2016, 1, 1), "d")) == [30, 0, -1, -11, None]


def test_month_end_is_not_a_whole_month_early(spark):
    df = spark.createDataFrame([(date(2016, 1, 31),)], "d date")
    assert one(df, encode.whole_months_until(date(2016, 2, 29), "d")) == [0]


def test_tenure_rounds_down_below_zero(spark):
    rows = [
        (date(2013, 6, 15), date(2016, 6, 15)),
        (date(2016, 1, 2), date(2016, 1, 1)),
        (date(2015, 1, 1), date(2015, 12, 31)),
        (None, date(2015, 12, 31)),
    ]
    df = spark.createDataFrame(rows, "a date, b date").coalesce(1)
    assert one(df, encode.tenure_years("a", "b")) == [3, -1, 0, None]


def test_flag_keeps_null_and_rejects_other_text(spark):
    df = spark.createDataFrame([("t",), ("f",), (None,), ("1",)], "g string").coalesce(1)
    assert one(df, encode.flag("g")) == [1, 0, None, 1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "g string").select(encode.flag("g")).collect()


def test_log_is_null_outside_its_domain(spark):
    df = spark.createDataFrame([(99.0,), (0.0,), (-1.0,), (-5.0,), (None,)], "x double").coalesce(1)
    assert one(df, encode.log10p1("x")) == [2.0, 0.0, None, None, None]
    row = log_summary(df, ["x"]).first()
    assert (row["n"], row["n_invalid"]) == (4, 2)


@pytest.mark.parametrize(
    "value, digits, expected",
    [(2.5, 0, 2.0), (0.12345, 4, 0.1234), (0.00125, 4, 0.0012), (2.675, 2, 2.68)],
)
def test_half_even(spark, value, digits, expected):
    df = spark.range(1).select(F.lit(value).alias("x"))
    assert one(df, columns.half_even(F.col("x"), digits)) == [expected]


def test_half_even_has_no_negative_zero(spark):
    df = spark.range(1).select(F.lit(-0.001).alias("x"))
    assert str(one(df, columns.half_even(F.col("x"), 2))[0]) == "0.0"


def test_relative_difference_of_zero_base_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "c double, r double").coalesce(1)
    change = columns.relative_difference_pct(F.col("c"), F.col("r"))
    assert one(df, change) == [None, 50.0]


def test_column_choice(spark):
    df = spark.createDataFrame(
        [("a", date(2015, 1, 1), 1.0, 2)], "id string, price_date date, price_a double, price_b int"
    )
    assert columns.with_prefix(df, "price_") == ["price_date", "price_a", "price_b"]
    assert columns.numeric(df, columns.with_prefix(df, "price_")) == ["price_a", "price_b"]
    assert columns.present(df, ["price_b", "missing"]) == ["price_b"]


def test_name_matches_ignores_case(spark):
    names = ["forecast_PRICE_x", "off_peak_y", "margin"]
    df = spark.createDataFrame([(n,) for n in names], "feature string").coalesce(1)
    assert one(df, columns.name_matches("feature", "price|peak")) == [True, True, False]


def test_mean_ignores_nulls_and_is_null_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "x double, y double")
    row = df.agg(columns.mean("x").alias("x"), columns.mean("y").alias("y")).first()
    assert (row["x"], row["y"]) == (1.5, None)
