"""Rounding, cleaning and classification on hand-made values."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from civicscope.functions import numbers as n
from civicscope.functions import text as t
from civicscope.functions.classify import classify, keyword_category


def column(spark, values, dtype, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    found = rows.select("i", build(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_round_half_even_equals_python_round(spark, digits):
    rng = random.Random(7)
    values = [0.05, 0.15, 0.25, 0.35, 0.45, 1.005, 2.675, 2.5, -2.5, -0.25, 0.125, 0.375, 1e15, 0.0, 99.95, 0.995]
    values += [rng.uniform(-1000, 1000) for _ in range(300)]
    values += [rng.randrange(-99999, 99999) / 1000 for _ in range(2000)]
    found = column(spark, values, "double", lambda c: n.round_half_even(c, digits))
    assert found == [round(v, digits) + 0.0 for v in values]


def test_round_half_up_scales_first(spark):
    found = column(spark, [1.005, 2.5, -2.5, 0.25, None], "double", lambda c: n.round_half_up(c, 2))
    assert found == [1.0, 2.5, -2.5, 0.25, None]
    assert column(spark, [2.5, -2.5, 0.5], "double", lambda c: n.round_half_up(c, 0)) == [3.0, -3.0, 1.0]


def test_display_and_number_text(spark):
    shown = column(spark, [62.0, 62.55, None], "double", lambda c: n.number_text(n.display_value(c)))
    assert shown == ["62", str(round(62.55, 1)), None]
    assert column(spark, [12345678.9, -0.0001, 1e9], "double", n.number_text) == ["12345678.9", "-0.0001", "1000000000"]
    assert column(spark, [0.5, 1.5, 2.5], "double", n.fixed_text) == ["0", "2", "2"]


def test_grouped_and_signed_text(spark):
    assert column(spark, [1234567.0, None], "double", lambda c: n.grouped_text(c, 0, "$")) == ["$1,234,567", "—"]
    delta = column(spark, [1500.0, 500.0, None], "double", lambda c: n.signed_delta_text(c, F.lit(1000.0), 0, "$"))
    assert delta == ["+$500", "-$500", None]
    assert column(spark, [12.4, -0.4, None], "double", n.signed_percent_text) == ["+12%", "-0%", None]


def test_weighted_mean_denominators(spark):
    rows = spark.createDataFrame([(10.0, 1), (None, 3)], "v double, w int")
    found = rows.agg(
        n.weighted_mean(F.col("v"), F.col("w")).alias("all"),
        n.weighted_mean(F.col("v"), F.col("w"), skip_null_weight=True).alias("known"),
    ).first()
    assert (found["all"], found["known"]) == (2.5, 10.0)
    empty = rows.filter("w > 5").agg(n.weighted_mean(F.col("v"), F.col("w")).alias("x")).first()
    assert empty["x"] is None


def test_ratio_with_zero_population(spark):
    rows = spark.createDataFrame([(5, 0), (5, 1000), (5, None)], "a int, p int")
    found = rows.select(n.per_thousand(F.col("a"), F.col("p"), 1).alias("r")).collect()
    assert [r["r"] for r in found] == [None, 5.0, None]


def test_dates(spark):
    found = column(spark, ["1/5/2020", "10/11/2019", "13/45/2020", "", None], "string", t.parse_date)
    assert found == [date(2020, 1, 5), date(2019, 10, 11), None, None, None]


def test_numbers_and_sentinel(spark):
    found = column(spark, ["12.6", "-666666666", "x", "7"], "string", t.estimate)
    assert found == [13, None, None, 7]


def test_postal_key(spark):
    found = column(spark, ["92101-1234", "CA 92101", "9210", None], "string", t.postal_key)
    assert found == ["92101", "92101", None, None]


def test_status(spark):
    rows = spark.createDataFrame([(date(2020, 1, 1),), (date(2021, 1, 1),), (None,)], "e date")
    found = rows.select(t.activity_status(F.col("e"), F.lit("2021-01-01").cast("date")).alias("s")).collect()
    assert [r["s"] for r in found] == ["inactive", "active", "active"]


def test_ordinals_badges_and_maturity(spark):
    assert column(spark, [1, 2, 3, 4, 11, 12, 13, 21, 112], "int", t.ordinal) == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    rows = spark.createDataFrame(
        [(3, 80, "low"), (1, 200, "high"), (60, 80, "high"), (5, 80, "neutral")], "r int, o int, s string"
    )
    found = [r[0] for r in rows.select(t.rank_badge(F.col("r"), F.col("o"), F.col("s"))).collect()]
    assert found == ["3rd lowest of 80", "top 1% · rank 1 of 200", "rank 60 of 80", "rank 5 of 80"]
    assert column(spark, [1.9, 2.0, 5.0, 8.0, None], "double", t.maturity) == [
        "emerging", "growing", "maturing", "established", ""]


def test_classification_steps(spark):
    cases = [
        ("722511", "x", "restaurant"),
        ("722514.0", "x", "cafe & snack bar"),
        ("72259", "x", "restaurant"),
        ("729999", "x", "food & accommodation"),
        ("999999", "The Barber Shop", "drinking places"),
        ("999999", "quiet", "other"),
        (None, "yoga", None),
        ("54", None, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, code string, words string, want string")
    found = rows.select("want", classify(F.col("code"), F.col("words")).alias("got"), "i").collect()
    assert [r["got"] for r in sorted(found, key=lambda r: r["i"])] == [c[2] for c in cases]
    loose = rows.filter("i >= 6").select(classify(F.col("code"), F.col("words"), strict_nulls=False)).collect()
    assert [r[0] for r in loose] == ["recreation & fitness", "professional services"]


def test_keyword_order_decides(spark):
    found = column(spark, ["Sushi Bar", "plain"], "string", keyword_category)
    assert found == ["restaurant", None]
