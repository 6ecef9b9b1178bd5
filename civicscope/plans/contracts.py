"""Column contracts of the built tables, checked before a table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_MOMENTUM = "momentum_score double, biz_formation_yoy double, permit_yoy double, crime_yoy double, solar_yoy double"
_AGES = "category string, business_count bigint, median_age_years double, avg_age_years double, pct_under_2yr double, pct_over_10yr double"
_DEMOGRAPHICS = (
    "zip_code string, population int, median_age float, median_income int, median_home_value int, median_rent int, "
    "education_total int, bachelors_plus int, pct_bachelors_plus double"
)

CONTRACTS = {
    "businesses": "account_id string, business_name string, address string, zip_code string, naics_code string, "
    "activity_description string, category string, start_date date, created_date date, expiration_date date, "
    "status string",
    "demographics": _DEMOGRAPHICS,
    "demographics_by_zip": _DEMOGRAPHICS,
    "business_by_zip": "zip_code string, category string, total_count bigint, active_count bigint",
    "business_summary": "zip_code string, total_count bigint, active_count bigint, category_count bigint, "
    "earliest_start date, latest_start date",
    "neighborhood_profile": "zip_code string, neighborhood string, area string, active_count bigint, "
    "total_count bigint, category_count bigint, population int, median_age float, median_income int, "
    "median_home_value int, median_rent int, pct_bachelors_plus double, businesses_per_1k double, "
    "new_permits bigint, permit_valuation double, solar_installs bigint, crime_count bigint, "
    "median_311_days double, total_311_requests bigint",
    "area_business_by_category": "area string, category string, active_count bigint, total_count bigint, per_1k double",
    "trend_business_formation": "zip_code string, year int, new_businesses bigint",
    "business_age_stats": f"zip_code string, {_AGES}",
    "business_age_by_area": f"area string, {_AGES}",
    "momentum_scores": f"zip_code string, {_MOMENTUM}",
    "momentum_by_area": f"area string, {_MOMENTUM}",
    "zip_centroids": "zip_code string, lat double, lng double",
    "zip_to_neighborhood": "zip_code string, neighborhood string",
    "zip_area": "zip_code string, area string",
    "area_profile": "area string, zip_count bigint, population bigint, median_age double, median_income double, "
    "median_home_value double, median_rent double, pct_bachelors_plus double, active_count bigint, total_count bigint, "
    "new_permits bigint, permit_valuation double, solar_installs bigint, crime_count bigint, median_311_days double, "
    "total_311_requests bigint, businesses_per_1k double",
    "city_averages": "avg_population double, avg_median_age double, avg_median_income double, "
    "avg_median_home_value double, avg_median_rent double, avg_pct_bachelors_plus double, avg_active_businesses double, "
    "avg_total_businesses double, avg_category_count double, avg_businesses_per_1k double, avg_crime_count double, "
    "avg_median_311_days double, avg_new_permits double, avg_solar_installs double",
    "trend_311_monthly": "year int, month int, total_requests bigint, closed_requests bigint, "
    "avg_resolution_days double, median_resolution_days double",
    "yearly_series": "zip_code string, series string, year int, count bigint",
    "business_cube": "zip_code string, category string, status string, start_date date, n bigint",
    "business_cells": "zip_code string, category string, total_count bigint, active_count bigint, "
    "earliest_start date, latest_start date",
    "business_sketches": "zip_code string, category string, distinct_sketch binary, start_sketch binary",
    "start_histogram": "zip_code string, category string, start_date date, n bigint",
}


def contract(name: str) -> StructType | None:
    """The contract of a table, None when it has none."""
    return StructType.fromDDL(CONTRACTS[name]) if name in CONTRACTS else None


def check_contract(name: str, df: DataFrame) -> DataFrame:
    """The frame, if its columns have the names and types of the contract; else an error."""
    wanted = contract(name)
    if wanted is None:
        return df
    expected = {(f.name, f.dataType.simpleString()) for f in wanted}
    found = {(f.name, f.dataType.simpleString()) for f in df.schema}
    if expected != found:
        missing, extra = sorted(expected - found), sorted(found - expected)
        raise ValueError(f"table {name} breaks its contract: missing {missing}, unexpected {extra}")
    return df
