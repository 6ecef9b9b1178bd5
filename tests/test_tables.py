"""Table builders, optional inputs and the question layer."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from civicscope.plans import profiles, tables
from civicscope.plans.answers import Answers
from civicscope.plans.tables import KEY, Tables

RAW = "`BUSINESS ACCT#` string, `dba name` string, Zip string, naics string, `ACTIVITY DESC` string, `START DT` string, `EXP DT` string"


def raw_register(spark):
    return spark.createDataFrame(
        [
            ("1", "Bar One", "92101-0001", "722410", "bar", "1/5/2020", None),
            ("1", "Bar One", "92101-0001", "722410", "bar", "1/5/2020", None),
            ("2", "Old Shop", "CA 92102", "999999", "corner shop", "13/45/2020", "12/31/2019"),
            ("3", "No Zip", "921", "722410", "bar", None, None),
            ("4", "Blank", "92101", None, "yoga", "10/11/2019", "1/1/2021"),
        ],
        RAW,
    )


def test_register_cleaning(spark):
    got = {r["account_id"]: r for r in tables.businesses(raw_register(spark), "2021-01-01").collect()}
    assert sorted(got) == ["1", "2", "4"]
    assert got["1"]["category"] == "drinking places" and got["1"]["start_date"] == date(2020, 1, 5)
    assert got["2"]["status"] == "inactive" and got["2"]["start_date"] is None and got["2"][KEY] == "92102"
    assert got["4"]["category"] is None and got["4"]["status"] == "active"
    assert got["1"]["address"] is None


def test_register_without_postal_code(spark):
    with pytest.raises(ValueError):
        tables.businesses(spark.createDataFrame([("1",)], "name string"), "2021-01-01")


def test_demographics(spark):
    names = ["B01003_001E", "B01002_001E", "B19013_001E", "B25077_001E", "B25064_001E", "B15003_001E",
             "B15003_022E", "B15003_023E", "B15003_024E", "B15003_025E", tables.SURVEY_KEY]
    rows = [
        ("1000", "33.4", "-666666666", "12.6", "800", "200", "10", "-666666666", "5", "1", "92101"),
        ("-666666666", "33.4", "5", "5", "5", "0", "1", "1", "1", "1", "92102"),
    ]
    got = {r[KEY]: r for r in tables.demographics(spark.createDataFrame(rows, names)).collect()}
    first = got["92101"]
    assert (first["population"], first["median_income"], first["median_home_value"]) == (1000, None, 13)
    assert (first["bachelors_plus"], first["pct_bachelors_plus"]) == (16, 8.0)
    assert got["92102"]["population"] is None and got["92102"]["pct_bachelors_plus"] is None


def small_sources(spark):
    return {
        "names": spark.createDataFrame([("1", "North"), ("2", "South"), ("3", "East")], "zip_code string, neighborhood string"),
        "areas": spark.createDataFrame([("1", "A"), ("2", "A")], "zip_code string, area string"),
    }


def test_absent_inputs_give_nulls(spark):
    graph = Tables(small_sources(spark).get, "2021-01-01", 2019, 2020)
    rows = {r[KEY]: r for r in graph["neighborhood_profile"].collect()}
    assert rows["3"]["area"] == "Other" and rows["1"]["population"] is None and rows["1"]["crime_count"] is None
    assert {r["area"]: r["zip_count"] for r in graph["area_profile"].collect()} == {"A": 2, "Other": 1}
    assert graph.get("momentum_scores") is None and graph.get("city_averages") is None
    nested = profiles.place_profiles(graph)
    assert nested.count() == 3 and "momentum" not in nested.columns
    with pytest.raises(KeyError):
        graph["momentum_scores"]


def test_gazetteer(spark):
    raw = spark.createDataFrame(
        [(" 1 ", "0", " 32.7 ", " -117.1  "), (" 9 ", "0", "33", "-117"), ("2", "0", "", "-117")],
        ["GEOID", "ALAND", "INTPTLAT", "INTPTLONG      "],
    )
    profiled = spark.createDataFrame([("1",), ("2",)], "zip_code string")
    assert [tuple(r) for r in tables.centroids(raw, profiled).collect()] == [("1", 32.7, -117.1)]
    assert tables.centroids(raw).count() == 2


def test_lists_are_cut_only_by_the_callers_limit(spark):
    source = small_sources(spark)
    many = spark.range(600).select(
        F.col("id").cast("string").alias("account_id"),
        F.concat(F.lit("b"), F.col("id")).alias("business_name"),
        F.lit("x").alias("address"),
        F.lit("1").alias("zip_code"),
        F.lit("bar").alias("category"),
        F.lit("2020-01-01").cast("date").alias("start_date"),
        F.lit("active").alias("status"),
    )
    source["businesses"] = many
    source["demographics"] = spark.createDataFrame(
        [("1", 1000, 30.0, 1, 1, 1, 1, 1, 1.0)],
        "zip_code string, population int, median_age float, median_income int, median_home_value int, median_rent int, "
        "education_total int, bachelors_plus int, pct_bachelors_plus double",
    )
    answers = Answers(Tables(source.get, "2021-01-01", 2019, 2020))
    assert answers.competitors("bar", "1").count() == 600 == answers.businesses(limit=10**6).count()
    assert answers.competitors("bar", "1", 7).count() == answers.businesses(limit=7).count() == 7
    row = answers.competitor_density("bar", "1").first()
    assert (row["count"], row["density"], row["city_avg_density"]) == (600, 600.0, 600.0)


# ---------------------------------------------------------------- properties on the stand-ins


def test_area_sums_equal_place_sums(domain):
    places = domain.tables["neighborhood_profile"].agg(F.sum("active_count"), F.sum("crime_count"), F.sum("population")).first()
    areas = domain.tables["area_profile"].agg(F.sum("active_count"), F.sum("crime_count"), F.sum("population")).first()
    assert tuple(places) == tuple(areas)


def test_scores_and_percentiles_are_bounded(domain):
    low, high = domain.tables["momentum_scores"].agg(F.min("momentum_score"), F.max("momentum_score")).first()
    assert 0 <= low <= high <= 100
    low, high = domain.answers.percentile_ranks().agg(F.min("percentile"), F.max("percentile")).first()
    assert (low, high) == (0, 100)


def test_layers_give_points_and_filters_narrow_them(domain):
    answers = domain.answers
    for layer in ("311", "permits", "crime", "solar"):
        assert answers.map_points(layer, sample=10).count() == 10 < answers.map_points(layer).count()
    assert answers.map_points("unknown").count() == 0
    everything = answers.map_points("permits").count()
    assert 0 < answers.map_points("permits", zip_code="7", year_min=1997, year_max=2000).count() < everything


def test_trends_of_one_place_equal_its_part_of_all(domain):
    one = domain.answers.zip_trends("3")
    part = domain.answers.zip_trends().filter("zip_code = '3'")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, part.collect()))


def test_nearby_is_near_and_limited(domain):
    found = domain.answers.nearby_competitors("restaurant", "7").collect()
    centre = domain.answers.centroids().filter("zip_code = '7'").first()
    assert 0 < len(found) <= 20
    assert all(abs(r["lat"] - centre["lat"]) <= 0.11 and abs(r["lng"] - centre["lng"]) <= 0.11 for r in found)


def test_profile_of_one_place(domain):
    row = domain.answers.profile("7").first()
    assert row["business_landscape"]["active_count"] > 0
    assert [c["active_count"] for c in row["top_categories"]] == sorted(
        (c["active_count"] for c in row["top_categories"]), reverse=True)
    assert row["percentiles"]["crime_count"]["of"] == 10
    assert row["narrative"].startswith(("compared to", "close to"))
    assert len(row["business_age"]) <= 5 and row["momentum"]["momentum_score"] is not None


def test_bad_ranking_metric(domain):
    with pytest.raises(ValueError):
        domain.answers.rankings("nope")
    with pytest.raises(ValueError):
        domain.answers.rankings("category_per_1k")
