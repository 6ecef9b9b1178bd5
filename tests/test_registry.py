"""Registered queries against their SQL oracles on the smallest data."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spark_entry
from tests.conftest import SMALL
from tools.check_oracle import TABLES, rows_of

CHECKED = [
    "businesses", "category_counts", "place_summary", "median_age", "classify_text", "classify_record",
    "area_profile", "city_averages", "momentum", "percentiles", "rankings_category_context", "area_trends",
    "city_trends", "map_points_place", "map_points_all", "map_points_sample", "latest_breakdown", "businesses_lookup",
    "competitors", "competitor_density", "nearby_all_centres", "hex_density", "dow_month_grid", "permit_timelines",
    "vs_average", "area_head_to_head", "businesses_head", "map_points_place_stored",
    "narrative", "area_narrative", "comparison_narrative", "incremental_load",
    "business_cube", "cube_extended", "formation_from_cube", "distinct_rollup", "median_rollup", "formation_trend", "age_by_place", "age_by_area",
    "crime_detail_stored", "crime_temporal_stored", "profile_ages", "profile_figures", "area_profile_permit_timelines",
    "text_files_union", "key_range_rows", "lookup_rows", "rows_written", "metrics_allowed", "profile_figures_bucketed",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    df = spark_entry.queries()[name](spark, SMALL)
    found = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    cursor = duck.execute(spark_entry.oracle_sql()[name])
    expected = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description], dtype=object)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def test_every_oracle_belongs_to_a_query():
    queries, oracles = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(oracles) <= set(queries)
    queries = [q for q in queries if q != "pipeline" and not q.startswith("op")]
    assert set(queries) - set(oracles) == {"dataset_health", "profiles_nested", "area_profiles_nested"}


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 10 and "category_per_1k" in df.columns
