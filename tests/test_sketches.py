"""Mergeable sketches against exact counts and order statistics."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from civicscope.operators import counts, sketches
from civicscope.plans.tables import as_date
from civicscope.streaming.incremental import extend_sketches

TODAY = "2020-01-01"
SCHEMA = "zip_code string, category string, business_name string, start_date date, status string"


def day(n):
    return datetime.date(1960, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def facts(spark):
    """A hot place with three fifths of its starts on one day, many small places, places without any start."""
    rng = random.Random(5)
    rows = [("hot", "a", f"n{rng.randrange(9000)}", day(7000 if i % 5 < 3 else rng.randrange(20000)), "active") for i in range(30000)]
    rows += [(f"z{i % 40}", rng.choice("ab"), f"n{rng.randrange(400)}", day(int(rng.paretovariate(1) * 50) % 20000), rng.choice(["active", "inactive"])) for i in range(6000)]
    rows += [("none", None, None, None, "active"), ("none", "a", None, day(3), "inactive")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_bounds_shrink_with_the_size_of_the_sketch():
    assert 0.06 < sketches.distinct_bound() < 0.07 and sketches.distinct_bound(14) == pytest.approx(sketches.distinct_bound() / 2)
    assert 0.026 < sketches.rank_bound() < 0.027 and sketches.rank_bound(400) < 0.55 * sketches.rank_bound()


@pytest.mark.parametrize("by", [["zip_code"], ["category"], []])
def test_merged_sketches_stay_within_their_bounds(facts, by):
    cells = sketches.business_sketches(facts, ["zip_code", "category"])
    told = sketches.estimates(sketches.merged_sketches(cells, by), as_date(TODAY))
    found = {tuple(r[c] for c in by): r for r in told.collect()}
    exact = {
        tuple(r[c] for c in by): r
        for r in facts.groupBy(*by).agg(
            F.count_distinct("business_name").alias("d"),
            F.count_if((F.col("status") == "active") & F.col("start_date").isNotNull()).alias("n"),
        ).collect()
    }
    assert set(found) == set(exact)
    for key, r in found.items():
        assert abs(r["distinct_estimate"] - exact[key]["d"]) <= exact[key]["d"] * sketches.distinct_bound() + 1
        assert r["start_count"] == exact[key]["n"]
        assert (r["median_start"] is None) == (r["start_count"] == 0) == (r["median_age_years"] is None)
    histogram = counts.start_histogram(facts, by)
    errors = [r["rank_error"] for r in sketches.rank_errors(histogram, told, by).collect()]
    assert errors and max(errors) <= sketches.rank_bound()


def test_a_day_that_most_rows_share_is_the_median(facts):
    told = sketches.estimates(sketches.business_sketches(facts, ["zip_code"]), as_date(TODAY))
    hot = told.filter("zip_code = 'hot'").first()
    assert hot["median_start"] == day(7000) and hot["median_age_years"] == round((datetime.date(2020, 1, 1) - day(7000)).days / 365.25, 1)


def test_rank_error_sees_a_wrong_median(spark):
    histogram = spark.createDataFrame([("x", day(1), 90), ("x", day(2), 10)], "k string, start_date date, n bigint")
    for n, error in ((1, 0.0), (2, 0.4), (0, 0.5), (9, 0.5)):
        told = spark.createDataFrame([("x", day(n))], "k string, median_start date")
        assert sketches.rank_errors(histogram, told, ["k"]).first()["rank_error"] == pytest.approx(error)


def test_new_files_extend_the_sketches(spark, facts, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    (first, second) = facts.randomSplit([0.5, 0.5], 3)
    first.write.mode("append").parquet(source)
    once = extend_sketches(spark, source, root, facts.schema)
    assert once.columns == ["zip_code", "category", "distinct_sketch", "start_sketch"]
    second.write.mode("append").parquet(source)
    both = sketches.merged_sketches(extend_sketches(spark, source, root, facts.schema), [])
    again = sketches.merged_sketches(extend_sketches(spark, source, root, facts.schema), [])
    whole = sketches.merged_sketches(sketches.business_sketches(facts, ["zip_code"]), [])
    read = [sketches.estimates(s, as_date(TODAY)).select("distinct_estimate", "start_count").first() for s in (both, again, whole)]
    assert read[0] == read[1] and read[0]["start_count"] == read[2]["start_count"]
    assert read[0]["distinct_estimate"] == pytest.approx(read[2]["distinct_estimate"], rel=sketches.distinct_bound())


def test_no_facts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    cells = sketches.business_sketches(empty, ["zip_code"])
    assert sketches.estimates(cells, as_date(TODAY)).count() == 0
    city = sketches.estimates(sketches.merged_sketches(cells, []), as_date(TODAY)).first()
    assert city["distinct_estimate"] in (0, None) and city["median_start"] is None
