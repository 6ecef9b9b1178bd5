"""Registered queries: one per operator, over the whole tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.classify import classify, code_category, keyword_category, lookup
from civicscope.functions.numbers import (
    grouped_text,
    round_half_up,
    share_percent,
    signed_delta_text,
    signed_percent_text,
    weighted_mean,
)
from civicscope.functions.text import maturity, parse_date, postal_key, rank_badge
from civicscope.operators import compare, counts, geo, sketches, trends
from civicscope.operators.relations import (
    complete_mapping,
    having_key_in,
    require_metric,
    shared_folder,
    top_n,
    where_between,
    with_row,
)
from civicscope.plans import profiles
from civicscope.plans.answers import Answers
from civicscope.plans.build import PERIODS, bucketed_parts
from civicscope.plans.tables import KEY, Tables, as_date, demographics
from civicscope.sources import files, layers
from civicscope.streaming.incremental import extend_cube, extend_sketches, load_new_files
from standins.tables import AS_OF, CURRENT_YEAR, FIRST_YEAR, PEERS, PREVIOUS_YEAR, Domain, text

Query = Callable[[SparkSession, str], DataFrame]

PLACE, OTHER_PLACE, CATEGORY = "7", "8", "restaurant"
ORIGIN = (32.5, -117.2)
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    """Register a query under its function name."""
    REGISTRY[build.__name__] = lambda spark, folder: build(Domain(spark, folder))
    return build


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Fix the decimals of columns whose floating sums depend on the order of rows."""
    return df.withColumns({n: round_half_up(F.col(n), digits) for n in names})


def neighbours_of(df: DataFrame, key: Column, succ: Column, name: str) -> DataFrame:
    return df.select(key.alias(f"{name}_a"), succ.alias(f"{name}_b"))


def place_pairs(d: Domain) -> DataFrame:
    key = F.col("s_suppkey")
    return neighbours_of(d.supplier, key.cast("string"), (key + 1).cast("string"), KEY)


def area_pairs(d: Domain) -> DataFrame:
    left = d.read("nation").select(F.col("n_name").alias("area_a"), ((F.col("n_nationkey") + 1) % 25).alias("k"))
    right = d.read("nation").select(F.col("n_name").alias("area_b"), F.col("n_nationkey").alias("k"))
    return left.join(right, "k").drop("k")


# ---------------------------------------------------------------- aggregation kit


@query
def category_counts(d):
    return counts.category_counts(d.businesses, [KEY, "category"])


@query
def place_summary(d):
    return counts.place_summary(counts.business_cells(d.businesses, KEY), KEY)


@query
def business_cube(d):
    return d.tables["business_cube"]


@query
def filter_values(d):
    return d.answers.filters()


@query
def semi_filter(d):
    return d.tables["demographics_by_zip"].select(KEY, "population", "median_income")


@query
def anti_unmapped(d):
    return complete_mapping(d.areas, d.names, KEY, "area")


@query
def keys_in_any(d):
    """Places with solar installs in 2001 or service plans."""
    return having_key_in(d.names, where_between(d.civic_solar, "year", 2001, 2001), d.plans, on=KEY)


@query
def weighted_mean_total(d):
    joined = d.tables["zip_area"].join(d.tables["demographics"], KEY)
    mean = weighted_mean(F.col("median_rent"), F.col("population"), 1)
    return joined.groupBy("area").agg(mean.alias("median_rent"))


@query
def weighted_mean_nonnull(d):
    joined = d.tables["zip_area"].join(d.tables["demographics"], KEY)
    mean = weighted_mean(F.col("median_rent"), F.col("population"), 1, skip_null_weight=True)
    return joined.groupBy("area").agg(mean.alias("median_rent"))


@query
def share_pct(d):
    share = share_percent(F.col("status") == "active", 1)
    return d.businesses.groupBy("category").agg(share.alias("pct_active"))


@query
def density_per_1k(d):
    return counts.place_rates(d.tables["business_by_zip"], d.tables["neighborhood_profile"], KEY)


@query
def city_density(d):
    return counts.city_rates(d.tables["business_by_zip"], d.tables["demographics_by_zip"], KEY)


@query
def ordered_list(d):
    found = d.tables["business_by_zip"].groupBy(KEY).agg(F.array_sort(F.collect_set("category")).alias("c"))
    return found.select(KEY, F.concat_ws(",", "c").alias("categories"))


@query
def median_age(d):
    histogram = counts.start_histogram(d.businesses, ["category"])
    return counts.age_statistics(histogram, ["category"], as_date(AS_OF), at_least=1)


@query
def dedup(d):
    return d.read("orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


# ---------------------------------------------------------------- cleaning


@query
def zip_normalise(d):
    key = postal_key(F.col("ZIP")).alias(KEY)
    return d.register.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


@query
def date_parse(d):
    day = parse_date(F.col("START DT")).alias("start_date")
    return d.register.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))


@query
def sentinel_null(d):
    return demographics(d.census).select(KEY, "population", "median_income", "median_rent", "bachelors_plus")


@query
def classify_code(d):
    size = F.col("p_size").cast("string")
    code = F.concat(F.col("p_size").cast("string"), F.lit("110"))
    return d.read("part").select(
        "p_partkey",
        code_category(code).alias("by_code"),
        code_category(F.concat(F.lit("72251"), F.substring(size, 1, 1))).alias("by_prefix"),
    )


@query
def classify_text(d):
    return d.read("documents").select("doc_id", keyword_category(F.col("text")).alias("category"))


@query
def classify_record(d):
    strict = classify(F.col("NAICS"), F.col("ACTIVITY DESC"))
    loose = classify(F.col("NAICS"), F.col("ACTIVITY DESC"), strict_nulls=False)
    return d.register.groupBy(strict.alias("category"), loose.alias("category_loose")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def status_flag(d):
    return d.cleaned_register.groupBy("status", "expiration_date").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- tables


@query
def businesses(d):
    return d.cleaned_register


@query
def demographics_table(d):
    return d.tables["demographics"]


@query
def neighborhood_profile(d):
    return d.job_graph(store=None)["neighborhood_profile"]


@query
def area_profile(d):
    return d.tables["area_profile"]


@query
def area_categories(d):
    return d.tables["area_business_by_category"]


@query
def city_averages(d):
    table = d.tables["city_averages"]
    return rounded(table, 6, *table.columns)


@query
def formation_trend(d):
    return d.tables["trend_business_formation"]


@query
def monthly_trend(d):
    return rounded(d.tables["trend_311_monthly"], 6, "avg_resolution_days")


@query
def age_by_place(d):
    return d.job_graph(store=None)["business_age_stats"]


@query
def age_by_area(d):
    return d.job_graph(store=None)["business_age_by_area"]


@query
def momentum(d):
    return d.job_graph(store=None)["momentum_scores"]


@query
def momentum_neutral(d):
    return d.job_graph(None, "neutral")["momentum_scores"]


@query
def momentum_by_area(d):
    return d.tables["momentum_by_area"]


@query
def zip_centroids(d):
    return d.tables["zip_centroids"]


@query
def name_lookup(d):
    return d.tables["zip_to_neighborhood"]


# ---------------------------------------------------------------- ranks


@query
def percentiles(d):
    return d.answers.percentile_ranks()


@query
def rankings(d):
    return d.answers.rankings("businesses_per_1k", limit=50)


@query
def rankings_momentum(d):
    return d.answers.rankings("momentum_score", limit=50)


@query
def rankings_category(d):
    return d.answers.rankings("category_per_1k", category=CATEGORY, limit=50)


@query
def rankings_category_context(d):
    return d.answers.rankings("median_rent", sort_desc=False, category=CATEGORY, limit=50)


@query
def rankings_display(d):
    return d.answers.named_metric(d.answers.rankings("population", limit=30), "population")


@query
def area_rankings(d):
    ranked = d.answers.area_rankings("crime_count", sort_desc=False, limit=20)
    return ranked.drop("category", "category_active", "category_per_1k")


@query
def area_rankings_category(d):
    return d.answers.area_rankings("category_per_1k", category=CATEGORY, limit=20)


@query
def top_n_per_place(d):
    order = [F.col("active_count").desc(), F.col("category")]
    return top_n(d.tables["business_by_zip"], [KEY], order, 3, "position")


@query
def top_categories(d):
    return profiles.top_categories(d.tables)


@query
def area_top_categories(d):
    return profiles.area_top_categories(d.tables)


@query
def momentum_top(d):
    return d.answers.momentum(20)


@query
def area_momentum_top(d):
    return d.answers.area_momentum(20)


@query
def business_age(d):
    return d.answers.business_age()


@query
def area_business_age(d):
    return d.answers.area_business_age()


# ---------------------------------------------------------------- trends


@query
def place_trends(d):
    return d.answers.zip_trends()


@query
def area_trends(d):
    return d.answers.area_trends()


@query
def city_trends(d):
    return d.answers.city_trends()


@query
def latest_yoy(d):
    return trends.latest_yoy(d.answers.zip_trends(), [KEY])


@query
def yoy_text(d):
    newest = trends.latest_yoy(d.answers.area_trends(), ["area"])
    return newest.select("area", "series", signed_percent_text(F.col("yoy_pct"), " yoy").alias("change"))


@query
def two_year_change(d):
    return trends.two_year_change(d.tables["yearly_series"], KEY, 1998, 2000)


@query
def series_span(d):
    return trends.year_span(trends.series_totals(d.tables["yearly_series"], [KEY]), [KEY])


# ---------------------------------------------------------------- map and neighbours


@query
def map_points(d):
    return d.answers.map_points("permits", year_min=1997, year_max=2000, center_lat=32.6, center_lng=-117.1)


@query
def map_points_all(d):
    return d.answers.map_points("permits")


@query
def map_points_sample(d):
    """The 1,000 points with the smallest scattered id (below 2**31, counted by its upper 12 bits)."""
    scattered = F.col("point_id").cast("long") * 40503 % 2147483647
    return d.answers.map_points("311", sample=1000, sample_by=scattered, sample_shift=19)


@query
def map_points_place(d):
    return d.answers.map_points("311", zip_code=PLACE)


@query
def map_points_place_stored(d):
    """The same over a layer that is stored along the curve."""
    path = f"{work_folder(d.spark)}/map_311"
    layers.write_layer(d.map_311, path)
    return Answers({"map_311": d.spark.read.parquet(path), "zip_centroids": d.tables["zip_centroids"]}).map_points("311", zip_code=PLACE)


@query
def point_classes(d):
    return d.answers.point_classes(d.map_permits).groupBy("point_class", "approval_year").agg(
        F.count(F.lit(1)).alias("points")
    )


@query
def nearby_places(d):
    return d.answers.nearby_competitors(CATEGORY, PLACE)


@query
def nearby_display(d):
    return d.answers.nearby_display(d.answers.nearby_competitors(CATEGORY, PLACE), PLACE, CATEGORY)


@query
def nearby_all_centres(d):
    return d.answers.nearby_all()


@query
def hex_density(d):
    return geo.hex_density(d.map_crime, ORIGIN, 100.0, ["year"])


@query
def grid_density(d):
    return geo.grid_density(d.map_crime, 0.01, ["crime_against"])


@query
def area_view_box(d):
    boxes = d.answers.area_boxes((32.7157, -117.1611))
    return rounded(boxes, 6, "center_lat", "center_lng", "half_deg")


# ---------------------------------------------------------------- market and civic


@query
def competitors(d):
    return d.answers.competitors(CATEGORY, PLACE)


@query
def competitor_density(d):
    return d.answers.competitor_density()


@query
def businesses_lookup(d):
    return d.answers.businesses(category=CATEGORY, status="inactive")


@query
def businesses_head(d):
    return d.answers.businesses(limit=20_000)


@query
def service_types(d):
    return d.answers.services()


@query
def service_types_top(d):
    return d.answers.services(limit=15)


@query
def crime_detail(d):
    return d.answers.crime_detail()


@query
def crime_temporal(d):
    return d.answers.crime_temporal(2000)


def by_period(d: Domain, name: str) -> Answers:
    """Answers over a civic table that is stored in one folder per year."""
    period, keys = PERIODS[name]
    return Answers({name: files.write_periods(getattr(d, name), f"{work_folder(d.spark)}/{name}", period, keys)})


@query
def crime_detail_stored(d):
    return by_period(d, "civic_crime_detail").crime_detail()


@query
def crime_temporal_stored(d):
    return by_period(d, "civic_crime_temporal").crime_temporal(2000)


@query
def dow_month_grid(d):
    return d.answers.weekday_month_grid()


@query
def latest_breakdown(d):
    return profiles.crime_breakdown(d.civic_crime)


@query
def area_latest_breakdown(d):
    return profiles.area_crime_breakdown(d.civic_crime, d.tables["zip_area"])


@query
def permit_timelines(d):
    return profiles.permit_timelines(d.civic_permit_timelines)


@query
def area_permit_timelines(d):
    return profiles.area_permit_timelines(d.civic_permit_timelines, d.tables["zip_area"])


@query
def energy_benchmark(d):
    return rounded(profiles.energy_benchmark(d.civic_energy), 6, "avg_kwh_per_customer")


@query
def area_energy(d):
    return profiles.area_energy(d.civic_energy, d.tables["zip_area"])


@query
def areas(d):
    return d.answers.areas()


@query
def area_zips(d):
    return d.answers.area_zips()


@query
def place_options(d):
    return d.answers.place_options()


# ---------------------------------------------------------------- comparisons and sentences


@query
def vs_average(d):
    return compare.versus_average(d.tables["neighborhood_profile"], d.tables["city_averages"], KEY)


@query
def area_vs_average(d):
    return compare.versus_average(d.tables["area_profile"], d.tables["city_averages"], "area")


@query
def delta_text(d):
    rows = with_row(d.tables["neighborhood_profile"], d.tables["city_averages"], "_avg")
    average = F.col("_avg")["avg_median_income"]
    return rows.select(
        KEY, signed_delta_text(F.col("median_income"), average, 0, "$", " vs avg").alias("income_delta")
    )


@query
def value_text(d):
    return d.tables["demographics"].select(
        KEY,
        grouped_text(F.col("population")).alias("population"),
        grouped_text(F.col("median_income"), 0, "$").alias("median_income"),
        grouped_text(F.col("pct_bachelors_plus"), 1).alias("pct_bachelors_plus"),
    )


@query
def head_to_head(d):
    return d.answers.compare_zips(place_pairs(d))


@query
def area_head_to_head(d):
    return d.answers.compare_areas(area_pairs(d))


@query
def winner_flags(d):
    rows = compare.with_winner(d.answers.compare_zips(place_pairs(d)))
    return rows.select("zip_code_a", "zip_code_b", "metric", "winner")


@query
def category_merge(d):
    return d.answers.category_merge(PLACE, OTHER_PLACE)


@query
def maturity_bucket(d):
    ages = d.tables["business_age_stats"]
    return ages.select(KEY, "category", "median_age_years", maturity(F.col("median_age_years")).alias("maturity"))


@query
def rank_badges(d):
    ranked = d.answers.percentile_ranks()
    sense = lookup(fixed.RANK_SENSE, F.col("metric"))
    return ranked.select(KEY, "metric", rank_badge(F.col("rank"), F.col("of"), sense).alias("badge"))


@query
def narrative(d):
    return profiles.place_narratives(d.tables)


@query
def comparison_narrative(d):
    return d.answers.compare_zips_narrative(place_pairs(d))


@query
def area_narrative(d):
    return profiles.area_narratives(d.tables)


@query
def area_comparison_narrative(d):
    return d.answers.compare_areas_narrative(area_pairs(d))


# ---------------------------------------------------------------- files and nested rows


TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations", "homelessness"]


def work_folder(spark: SparkSession) -> str:
    """A fresh subfolder of the shared folder."""
    return f"{shared_folder(spark)}/run-{os.urandom(6).hex()}"


@query
def dataset_health(d):
    health = files.dataset_health(d.spark, {n: f"{d.folder}/{n}.parquet" for n in TABLE_NAMES})
    listed = files.with_data_date(health.drop("modified"), files.health_summary(health))
    return listed.join(dataset_rows(d).drop("available"), "dataset", "left")


@query
def dataset_rows(d):
    dates = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return files.dataset_rows(d.spark, {n: f"{d.folder}/{n}.parquet" for n in TABLE_NAMES}, dates)


@query
def incremental_load(d):
    """Load the orders file through the file stream and read the target back."""
    work = work_folder(d.spark)
    schema = d.read("orders").schema
    return load_new_files(d.spark, f"{d.folder}/orders.parquet", f"{work}/orders", f"{work}/_seen", schema)


def order_texts(d: Domain) -> list[str]:
    """The orders as two text files of different layouts: codes of some unreadable, no status in the second."""
    work = work_folder(d.spark)
    key = F.col("o_orderkey")
    rows = d.read("orders").select(
        F.when(key % 10 == 3, F.concat(F.lit("no. "), text(key))).otherwise(F.concat(F.lit(" "), text(key))).alias("code"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        key,
    )
    paths = [f"{work}/even", f"{work}/odd"]
    for path, remainder, columns in zip(paths, (0, 1), (["code", "priority", "status"], ["priority", "code"])):
        rows.filter(key % 2 == remainder).select(*columns).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return paths


@query
def text_files_union(d):
    """All rows of text files with different layouts, matched by column name."""
    return files.read_text_table(d.spark, order_texts(d))


@query
def key_range_rows(d):
    """Rows of the text files whose code is a number within the range."""
    return files.keep_key_range(files.read_text_table(d.spark, order_texts(d)), "code", 100, 9000)


@query
def lookup_rows(d):
    """Orders per status and per name that a small look-up table gives it."""
    names = files.lookup_table(d.spark, {"F": "finished", "O": "open"}, "o_orderstatus", "status_name")
    # Two entries.
    joined = d.read("orders").join(F.broadcast(names), "o_orderstatus", "left")
    return joined.groupBy("o_orderstatus", "status_name").agg(F.count(F.lit(1)).alias("orders"))


@query
def rows_written(d):
    """The count observed while each table was written, and the count of what was read back."""
    work, found = work_folder(d.spark), []
    for name, keys in {"orders": ["o_custkey"], "lineitem": ["l_suppkey", "l_shipdate"], "events": ["user_id"]}.items():
        observed = files.write_sorted(d.read(name), f"{work}/{name}", keys)
        counted = files.read_table(d.spark, f"{work}/{name}").agg(F.count(F.lit(1)).alias("read_back"))
        found.append(counted.select(F.lit(name).alias("dataset"), F.lit(observed).cast("bigint").alias("written"), "read_back"))
    return reduce(DataFrame.unionByName, found)


@query
def metrics_allowed(d):
    """Which metric names pass the check, and for those the places with a value."""
    profile, told = d.tables["neighborhood_profile"], []
    for name in ["population", "crime_count", "permit_valuation", "neighborhood", "population; DROP TABLE x"]:
        try:
            known = F.count(require_metric(name, fixed.RANKING_METRICS))
        except ValueError:
            known = F.lit(None).cast("bigint")
        told.append(F.struct(F.lit(name).alias("metric"), known.alias("known")))
    return profile.agg(F.array(*told).alias("told")).select(F.inline("told"))


def stored_cubes(d: Domain) -> DataFrame:
    """The cubes of two halves of the businesses, the second half counted after the first."""
    work = work_folder(d.spark)
    rows = d.businesses
    late = F.year("start_date") % 2 == 0
    for part in (rows.filter(~late), rows.filter(late)):
        part.write.mode("append").parquet(f"{work}/businesses")
        cubes = extend_cube(d.spark, f"{work}/businesses", f"{work}/counted", rows.schema)
    return cubes


@query
def cube_extended(d):
    """The cubes of both halves merged to one."""
    return counts.merged_cube(stored_cubes(d), KEY)


@query
def formation_from_cube(d):
    """Formation from a job graph that is given the cubes, as they are stored, and no businesses."""
    given = {"business_cube": stored_cubes(d)}
    return Tables(given.get, AS_OF, PREVIOUS_YEAR, CURRENT_YEAR, first_year=FIRST_YEAR)["trend_business_formation"]


def rolled_up(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Sketches of areas and of the city from stored ones per (place, category), loaded in two halves."""
    work = work_folder(d.spark)
    rows = d.businesses
    late = F.year("start_date") % 2 == 0
    for part in (rows.filter(~late), rows.filter(late)):
        part.write.mode("append").parquet(f"{work}/businesses")
        stored = extend_sketches(d.spark, f"{work}/businesses", f"{work}/sketched", rows.schema)
    areas = sketches.merged_sketches(stored.join(d.tables["zip_area"], KEY), ["area"])
    return areas, sketches.merged_sketches(stored, [])


def scoped(areas: DataFrame, city: DataFrame) -> DataFrame:
    told = areas.select(F.lit("area").alias("scope"), "*")
    return told.unionByName(city.select(F.lit("city").alias("scope"), F.lit(None).cast("string").alias("area"), "*"))


@query
def distinct_rollup(d):
    """Distinct business names of areas and city, exact, and whether the merged estimate is within its bound."""
    told = sketches.estimates(scoped(*rolled_up(d)), as_date(AS_OF)).select("scope", "area", "distinct_estimate")
    located = d.businesses.join(d.tables["zip_area"], KEY)
    exact = scoped(
        located.groupBy("area").agg(F.count_distinct("business_name").alias("distinct_names")),
        d.businesses.agg(F.count_distinct("business_name").alias("distinct_names")),
    )
    same = (F.col("t.scope") == F.col("e.scope")) & F.col("t.area").eqNullSafe(F.col("e.area"))
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_names"))
    within = off <= F.col("distinct_names") * sketches.distinct_bound() + 1
    joined = exact.alias("e").join(told.alias("t"), same, "left")
    return joined.select("e.scope", "e.area", "distinct_names", within.alias("within_bound"))


@query
def median_rollup(d):
    """Median ages of areas and city, exact, and whether the merged median's rank is within its bound."""
    areas, city = [sketches.estimates(found, as_date(AS_OF)) for found in rolled_up(d)]
    starts = counts.start_histogram(d.businesses, [KEY])
    located = starts.join(d.tables["zip_area"], KEY).groupBy("area", "start_date").agg(F.sum("n").alias("n"))
    whole = starts.groupBy("start_date").agg(F.sum("n").alias("n"))
    errors = scoped(sketches.rank_errors(located, areas, ["area"]), sketches.rank_errors(whole, city, []))
    exact = scoped(*[counts.age_statistics(h, by, as_date(AS_OF), 1) for h, by in ((located, ["area"]), (whole, []))])
    same = (F.col("r.scope") == F.col("e.scope")) & F.col("r.area").eqNullSafe(F.col("e.area"))
    within = F.col("rank_error") <= sketches.rank_bound()
    joined = exact.alias("e").join(errors.alias("r"), same, "left")
    return joined.select("e.scope", "e.area", "business_count", "median_age_years", within.alias("within_bound"))


@query
def stored_job_graph(d):
    """Profiles from a job graph whose tables are written, clustered by key, and read back."""
    keys = {"business_by_zip": [KEY], "neighborhood_profile": [KEY], "zip_area": ["area"]}
    store = files.parquet_store(d.spark, work_folder(d.spark), keys)
    return d.job_graph(store)["area_profile"]


@query
def profiles_nested(d):
    return d.answers.profile()


@query
def area_profiles_nested(d):
    return d.answers.area_profile()


def spread(nested: DataFrame, key: str, section: str, by: str) -> DataFrame:
    """A map section of a nested profile as rows."""
    return nested.select(key, F.explode(section).alias(by, "_v")).select(key, by, "_v.*")


def listed(nested: DataFrame, key: str, section: str) -> DataFrame:
    """An array section of a nested profile as rows with their place."""
    rows = nested.select(key, F.posexplode(section).alias("position", "_v"))
    return rows.select(key, (F.col("position") + 1).alias("position"), "_v.*")


@query
def profile_percentiles(d):
    return spread(d.answers.profile(), KEY, "percentiles", "metric")


@query
def profile_comparisons(d):
    return spread(d.answers.profile(), KEY, "comparison_to_avg", "metric")


@query
def profile_narratives(d):
    return d.answers.profile().select(KEY, "narrative")


@query
def profile_top_categories(d):
    return listed(d.answers.profile(), KEY, "top_categories")


@query
def area_profile_comparisons(d):
    return spread(d.answers.area_profile(), "area", "comparison_to_avg", "metric")


@query
def area_profile_narratives(d):
    return d.answers.area_profile().select("area", "narrative")


@query
def area_profile_top_categories(d):
    return listed(d.answers.area_profile(), "area", "top_categories")


def bucketed_profiles(d: Domain) -> DataFrame:
    """Nested profiles whose parts are stored in equal buckets of the place."""
    source, store = bucketed_parts(d.spark, d.source, work_folder(d.spark), buckets=16)
    tables = Tables(source, AS_OF, PREVIOUS_YEAR, CURRENT_YEAR, "last", FIRST_YEAR, store, PEERS)
    return profiles.nested_places(tables)


@query
def profile_figures_bucketed(d):
    return opened(bucketed_profiles(d), KEY, "demographics", "business_landscape", "civic_signals")


@query
def profile_top_categories_bucketed(d):
    return listed(bucketed_profiles(d), KEY, "top_categories")


def opened(nested: DataFrame, key: str, *sections: str) -> DataFrame:
    """Struct sections of a nested profile as columns, for the keys that have the first."""
    return nested.filter(F.col(sections[0]).isNotNull()).select(key, *[f"{section}.*" for section in sections])


def register_sections(prefix: str, key: str, nested: Callable[[Domain], DataFrame]) -> None:
    """The sections of the nested profiles of places or of areas, one query each."""
    for name, section in {"crime": "crime_breakdown", "permit_timelines": "permit_timelines", "ages": "business_age"}.items():
        REGISTRY[f"{prefix}_{name}"] = lambda spark, folder, section=section: listed(nested(Domain(spark, folder)), key, section)
    for name, sections in {"energy": ["energy"], "momentum": ["momentum"], "figures": ["demographics", "business_landscape", "civic_signals"]}.items():
        REGISTRY[f"{prefix}_{name}"] = lambda spark, folder, sections=sections: opened(nested(Domain(spark, folder)), key, *sections)


register_sections("profile", KEY, lambda d: d.answers.profile())
register_sections("area_profile", "area", lambda d: d.answers.area_profile())
