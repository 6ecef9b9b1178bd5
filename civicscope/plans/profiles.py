"""Nested profiles of all places and all areas: one plan, one row per key.

A call for one place is the same frame with a key filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.numbers import display_value, round_half_even, round_half_up, safe_ratio
from civicscope.operators import counts
from civicscope.operators.compare import versus_average
from civicscope.operators.narrative import area_sentence, place_sentence
from civicscope.operators.ranks import percentiles, to_long
from civicscope.operators.relations import collect_top, latest, latest_row, row_of, top_n, with_row
from civicscope.plans.tables import KEY, Tables

# Lengths of the lists inside a profile.
TOP_CATEGORIES = 10
TOP_AGES = 5
TOP_PERMIT_TYPES = 3

AGE_FIELDS = ["category", "business_count", "median_age_years", "avg_age_years", "pct_under_2yr", "pct_over_10yr"]
MOMENTUM_FIELDS = ["momentum_score", "biz_formation_yoy", "permit_yoy", "crime_yoy", "solar_yoy"]
DEMOGRAPHIC_FIELDS = [
    "population",
    "median_age",
    "median_income",
    "median_home_value",
    "median_rent",
    "pct_bachelors_plus",
]
CIVIC_FIELDS = [
    "new_permits",
    "permit_valuation",
    "solar_installs",
    "crime_count",
    "median_311_days",
    "total_311_requests",
]


def shown(df: DataFrame, *, but: tuple[str, ...] = ()) -> DataFrame:
    """Output form of a table: floating columns to one decimal."""
    columns = [
        display_value(F.col(name)).alias(name) if kind in ("double", "float") and name not in but else F.col(name)
        for name, kind in df.dtypes
    ]
    return df.select(*columns)


def _section(profile: DataFrame, fields: list[str]) -> Column:
    floating = {n for n, kind in profile.dtypes if kind in ("double", "float")}
    return F.struct(
        *[(display_value(F.col(f)) if f in floating else F.col(f)).alias(f) for f in fields]
    )


def _comparisons(rows: DataFrame, key: str) -> DataFrame:
    """Map metric -> (value, city_avg, vs_avg_pct) per key, comparable metrics only."""
    entry = F.struct("metric", F.struct("value", "city_avg", "vs_avg_pct"))
    packed = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return rows.groupBy(key).agg(packed.alias("comparison_to_avg"))


# ---------------------------------------------------------------- parts of a place profile


def crime_breakdown(crime: DataFrame, key: str = KEY) -> DataFrame:
    """Counts by kind in each key's own latest year."""
    yearly = crime.groupBy(key, "year", "crime_against").agg(F.sum("count").alias("count"))
    return latest(yearly, "year", [key]).select(key, "year", "crime_against", "count")


def permit_timelines(timelines: DataFrame, key: str = KEY, n: int = TOP_PERMIT_TYPES) -> DataFrame:
    """The n most frequent permit types of each key's latest year with permits."""
    rows = latest(timelines, "year", [key], F.col("permit_count") > 0)
    rows = rows.select(
        key,
        "year",
        F.col("approval_type_clean").alias("permit_type"),
        "permit_count",
        round_half_up(F.col("median_days"), 0).alias("median_days"),
    )
    return top_n(rows, [key], [F.col("permit_count").desc(), F.col("permit_type")], n, "position")


def energy_benchmark(energy: DataFrame, key: str = KEY) -> DataFrame:
    """Energy use of each key's latest year."""
    return latest_row(energy, [key], "year", ["avg_kwh_per_customer", "total_kwh", "elec_customers"])


def _with_city_rate(rows: DataFrame, city: DataFrame) -> DataFrame:
    """The rows with their category's city rate; categories are a short list, so their rates are one map, not a join."""
    known = city.filter(F.col("category").isNotNull())
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("category", "city_per_1k"))).alias("rates"))
    return rows.withColumn("city_per_1k", F.try_element_at(row_of(table)["rates"], F.col("category")))


def top_categories(tables: Tables, n: int = TOP_CATEGORIES) -> DataFrame:
    """The n largest categories per place with local and city rates per 1,000."""
    by_zip, profile = tables["business_by_zip"], tables["neighborhood_profile"]
    peopled = profile.filter(F.col("population") > 0).select(KEY, "population")
    city = counts.city_rates(by_zip, peopled, KEY)
    order = [F.col("active_count").desc(), F.col("category")]
    rows = top_n(by_zip, [KEY], order, n, "position").join(peopled, KEY, "left")
    rows = _with_city_rate(rows, city)
    local = safe_ratio(F.col("active_count") * F.lit(1000.0), F.col("population"))
    return rows.select(
        KEY,
        "position",
        "category",
        "active_count",
        "total_count",
        round_half_even(local, 1).alias("per_1k"),
        display_value(F.col("city_per_1k")).alias("city_avg_per_1k"),
    )


def _ages(ages: DataFrame, key: str, n: int = TOP_AGES) -> DataFrame:
    order = [F.col("business_count").desc(), F.col("category")]
    return collect_top(ages, [key], order, n, AGE_FIELDS, "business_age")


def _momentum(scores: DataFrame, key: str) -> DataFrame:
    fields = F.struct(*[display_value(F.col(f)).alias(f) for f in MOMENTUM_FIELDS])
    return scores.select(key, fields.alias("momentum"))


def place_percentiles(tables: Tables) -> DataFrame:
    """The stored ranks and percentiles, or those of the tables at hand."""
    ready = tables.get("place_percentiles")
    return ranked_places(tables) if ready is None else ready


def place_profiles(tables: Tables) -> DataFrame:
    """The stored nested profiles of places, or those of the tables at hand."""
    ready = tables.get("place_profiles")
    return nested_places(tables) if ready is None else ready


def area_profiles(tables: Tables) -> DataFrame:
    """The stored nested profiles of areas, or those of the tables at hand."""
    ready = tables.get("area_profiles")
    return nested_areas(tables) if ready is None else ready


def ranked_places(tables: Tables) -> DataFrame:
    """Rank and percentile of every known metric of every profiled place.

    The growth score ranks among all scored places, the rest among profiled ones;
    all metrics share one ranking job.
    """
    profile, scores = tables["neighborhood_profile"], tables.get("momentum_scores")
    metrics = [m for m in fixed.PERCENTILE_METRICS if m in profile.columns]
    long = to_long(profile, [KEY], metrics)
    if scores is not None:
        long = long.unionByName(to_long(scores, [KEY], ["momentum_score"]))
    return percentiles(long, [KEY]).join(profile.select(KEY), KEY, "left_semi")


def place_narratives(tables: Tables) -> DataFrame:
    """(key, narrative) for all places."""
    rows = tables["neighborhood_profile"]
    scores, ages = tables.get("momentum_scores"), tables.get("business_age_stats")
    rows = rows.join(scores.select(KEY, "momentum_score"), KEY, "left") if scores is not None else rows.withColumn(
        "momentum_score", F.lit(None).cast("double")
    )
    rows = _with_top_age(rows, ages, KEY)
    rows = with_row(rows, tables["city_averages"], "_avg")
    return rows.select(
        KEY,
        place_sentence(
            F.col,
            lambda a: F.col("_avg")[a],
            F.col("momentum_score"),
            F.col("top_category"),
            F.col("top_age"),
            peer=tables.peers[0],
        ).alias("narrative"),
    )


def _with_top_age(rows: DataFrame, ages: DataFrame | None, key: str) -> DataFrame:
    if ages is None:
        return rows.select(
            "*", F.lit(None).cast("string").alias("top_category"), F.lit(None).cast("double").alias("top_age")
        )
    first = top_n(ages, [key], [F.col("business_count").desc(), F.col("category")], 1)
    first = first.select(key, F.col("category").alias("top_category"), F.col("median_age_years").alias("top_age"))
    return rows.join(first, key, "left")


def nested_places(tables: Tables) -> DataFrame:
    """One nested row per place; sections of absent tables are NULL."""
    profile = tables["neighborhood_profile"]
    averages = tables.get("city_averages")

    ranked = place_percentiles(tables)
    rank_map = F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("metric", F.struct("rank", "of", "percentile"))))
    )
    ranks = ranked.groupBy(KEY).agg(rank_map.alias("percentiles"))

    rows = profile.select(
        KEY,
        "neighborhood",
        "area",
        _section(profile, DEMOGRAPHIC_FIELDS).alias("demographics"),
        _section(profile, ["active_count", "total_count", "category_count", "businesses_per_1k"]).alias(
            "business_landscape"
        ),
        _section(profile, CIVIC_FIELDS).alias("civic_signals"),
    )
    parts = [ranks]
    if tables.get("business_by_zip") is not None:
        fields = ["category", "active_count", "total_count", "per_1k", "city_avg_per_1k"]
        parts.append(
            collect_top(top_categories(tables), [KEY], [F.col("position")], TOP_CATEGORIES, fields, "top_categories")
        )
    if tables.get("civic_crime") is not None:
        kinds = crime_breakdown(tables["civic_crime"])
        parts.append(_packed(kinds, KEY, "count", ["crime_against", "count"], "crime_breakdown"))
    if tables.get("civic_energy") is not None:
        use = energy_benchmark(tables["civic_energy"])
        fields = F.struct(display_value(F.col("avg_kwh_per_customer")).alias("avg_kwh_per_customer"), "total_kwh", "elec_customers")
        parts.append(use.select(KEY, fields.alias("energy")))
    if tables.get("civic_permit_timelines") is not None:
        lines = permit_timelines(tables["civic_permit_timelines"])
        fields = ["permit_type", "permit_count", "median_days"]
        parts.append(collect_top(lines, [KEY], [F.col("position")], TOP_PERMIT_TYPES, fields, "permit_timelines"))
    if tables.get("momentum_scores") is not None:
        parts.append(_momentum(tables["momentum_scores"], KEY))
    if tables.get("business_age_stats") is not None:
        parts.append(_ages(tables["business_age_stats"], KEY))
    if averages is not None:
        parts.append(_comparisons(versus_average(profile, averages, KEY), KEY))
        parts.append(place_narratives(tables))
    for part in parts:
        rows = rows.join(part, KEY, "left")
    return rows


def _packed(rows: DataFrame, key: str, score: str, fields: list[str], name: str) -> DataFrame:
    """All rows of a key as an array by falling score; for lists bounded by a small domain."""
    entry = F.struct((-F.col(score)).alias("_w"), *fields)
    shaped = F.transform(F.sort_array(F.collect_list(entry)), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return rows.groupBy(key).agg(shaped.alias(name))


# ---------------------------------------------------------------- parts of an area profile


def area_crime_breakdown(crime: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts by kind per area in the latest year of the whole table."""
    newest = latest(crime, "year").groupBy(KEY, "crime_against").agg(F.sum("count").alias("count"))
    located = newest.join(mapping.select(KEY, "area"), KEY)
    return located.groupBy("area", "crime_against").agg(F.sum("count").alias("count"))


def area_energy(energy: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mean use per customer and sums per area in the latest year of the whole table."""
    located = latest(energy, "year").join(mapping.select(KEY, "area"), KEY)
    return located.groupBy("area").agg(
        round_half_up(F.avg("avg_kwh_per_customer"), 0).alias("avg_kwh_per_customer"),
        F.sum("total_kwh").alias("total_kwh"),
        F.sum("elec_customers").alias("elec_customers"),
    )


def area_permit_timelines(timelines: DataFrame, mapping: DataFrame, n: int = TOP_PERMIT_TYPES) -> DataFrame:
    """The n most frequent permit types per area: counts summed, medians averaged."""
    newest = latest(timelines, "year", (), F.col("permit_count") > 0)
    located = newest.join(mapping.select(KEY, "area"), KEY)
    rows = located.groupBy("area", F.col("approval_type_clean").alias("permit_type")).agg(
        F.sum("permit_count").alias("permit_count"),
        round_half_up(F.avg("median_days"), 0).alias("median_days"),
    )
    return top_n(rows, ["area"], [F.col("permit_count").desc(), F.col("permit_type")], n, "position")


def area_top_categories(tables: Tables, n: int = TOP_CATEGORIES) -> DataFrame:
    """The n largest categories per area with area and city rates per 1,000."""
    city = counts.city_rates(tables["business_by_zip"], tables["demographics_by_zip"], KEY)
    order = [F.col("active_count").desc(), F.col("category")]
    rows = top_n(tables["area_business_by_category"], ["area"], order, n, "position")
    rows = _with_city_rate(rows, city)
    return rows.select(
        "area",
        "position",
        "category",
        "active_count",
        "total_count",
        display_value(F.col("per_1k")).alias("per_1k"),
        display_value(F.col("city_per_1k")).alias("city_avg_per_1k"),
    )


def area_narratives(tables: Tables) -> DataFrame:
    """(area, narrative) for all areas."""
    rows = tables["area_profile"]
    scores = tables.get("momentum_by_area")
    rows = rows.join(scores.select("area", "momentum_score"), "area", "left") if scores is not None else rows.withColumn(
        "momentum_score", F.lit(None).cast("double")
    )
    rows = _with_top_age(rows, tables.get("business_age_by_area"), "area")
    rows = with_row(rows, tables["city_averages"], "_avg")
    return rows.select(
        "area",
        area_sentence(
            F.col("area"),
            F.col("zip_count"),
            F.col,
            lambda a: F.col("_avg")[a],
            F.col("momentum_score"),
            F.col("top_category"),
            F.col("top_age"),
            peer=tables.peers[1],
        ).alias("narrative"),
    )


def nested_areas(tables: Tables) -> DataFrame:
    """One nested row per area; sections of absent tables are NULL."""
    profile, mapping = tables["area_profile"], tables["zip_area"]
    averages = tables.get("city_averages")
    rows = profile.select(
        "area",
        "zip_count",
        _section(profile, DEMOGRAPHIC_FIELDS).alias("demographics"),
        _section(profile, ["active_count", "total_count", "businesses_per_1k"]).alias("business_landscape"),
        _section(profile, CIVIC_FIELDS).alias("civic_signals"),
    )
    parts = []
    if tables.get("area_business_by_category") is not None:
        fields = ["category", "active_count", "total_count", "per_1k", "city_avg_per_1k"]
        cats = area_top_categories(tables)
        parts.append(collect_top(cats, ["area"], [F.col("position")], TOP_CATEGORIES, fields, "top_categories"))
    if tables.get("civic_crime") is not None:
        kinds = area_crime_breakdown(tables["civic_crime"], mapping)
        parts.append(_packed(kinds, "area", "count", ["crime_against", "count"], "crime_breakdown"))
    if tables.get("civic_energy") is not None:
        use = area_energy(tables["civic_energy"], mapping)
        parts.append(use.select("area", F.struct(*use.columns[1:]).alias("energy")))
    if tables.get("civic_permit_timelines") is not None:
        lines = area_permit_timelines(tables["civic_permit_timelines"], mapping)
        fields = ["permit_type", "permit_count", "median_days"]
        parts.append(collect_top(lines, ["area"], [F.col("position")], TOP_PERMIT_TYPES, fields, "permit_timelines"))
    if tables.get("momentum_by_area") is not None:
        parts.append(_momentum(tables["momentum_by_area"], "area"))
    if tables.get("business_age_by_area") is not None:
        parts.append(_ages(tables["business_age_by_area"], "area"))
    if averages is not None:
        parts.append(_comparisons(versus_average(profile, averages, "area"), "area"))
        parts.append(area_narratives(tables))
    for part in parts:
        rows = rows.join(part, "area", "left")
    return rows
