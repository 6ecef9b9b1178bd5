"""Selection of the first n rows against a plain sort."""

import pytest
from pyspark.sql import functions as F

from civicscope.operators.heads import By, first_rows

ORDERS = [
    [By("v"), By("id")],
    [By("v", descending=True, nulls_last=True), By("s", nulls_last=True), By("id", descending=True)],
    [By("s", descending=True), By("v", nulls_last=True), By("id")],
]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one value; values and texts may be null."""
    v = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 41 == 0, None).otherwise(F.col("id") * 37 % 101)
    s = F.when(F.col("id") % 13 == 0, None).otherwise(F.concat(F.lit("é"), (F.col("id") % 9).cast("string")))
    return spark.range(3000).select("id", v.cast("double").alias("v"), s.alias("s"), F.lit("x").alias("other")).repartition(5).cache()


@pytest.mark.parametrize("order", ORDERS)
def test_first_rows(spark, rows, order):
    want = [r["id"] for r in rows.orderBy(*[by.sort() for by in order]).collect()]
    for n in (1, 700, 1013, 2999, 3000, 9000):
        got = first_rows(rows, order, n, splitters=9, range_rows=40)
        assert got.columns == rows.columns
        assert sorted(r["id"] for r in got.collect()) == sorted(want[:n]), n


def test_ties_on_both_sides_of_the_cut(spark, rows):
    order = [By("v")]
    values = [r["v"] for r in rows.orderBy("v").collect()]
    for n in (500, 1200):  # inside a run of equal values
        got = [r["v"] for r in first_rows(rows, order, n, splitters=9, range_rows=40).orderBy("v").collect()]
        assert got == values[:n] and values[n - 1] == values[n]


def test_none_and_empty(spark, rows):
    assert first_rows(rows, ORDERS[0], 0).count() == 0
    assert first_rows(rows.limit(0), ORDERS[0], 5).count() == 0


def test_no_task_gathers_a_long_head(domain):
    found = domain.answers.businesses(limit=10**6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    assert found.count() == domain.answers.businesses().count()
