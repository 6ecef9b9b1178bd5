"""The questions users ask, one method each, over the tables of the job graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.numbers import (
    clamp,
    display_value,
    round_half_even,
    round_half_up,
    safe_ratio,
    signed_percent_text,
)
from civicscope.operators import compare, counts, geo, narrative, ranks, trends
from civicscope.operators.heads import By, first_rows
from civicscope.operators.relations import (
    SMALL_HEAD,
    latest,
    require_metric,
    smallest,
    top_n,
    where_between,
    where_equal,
    with_row,
)
from civicscope.plans import profiles
from civicscope.plans.tables import KEY, Tables
from civicscope.sources import layers

# Rows of the calls that are "top n" by nature.
NEARBY_ROWS = 20
AGE_ROWS = 15

# Map layer -> (table, year column).
LAYERS = {
    "311": ("map_311", "request_year"),
    "permits": ("map_permits", "approval_year"),
    "crime": ("map_crime", "year"),
    "solar": ("map_solar", "year"),
}

RANK_CONTEXT = ["population", "median_income", "active_count"]


def in_order(rows: DataFrame, order: Sequence[By], limit: int | None) -> DataFrame:
    """All rows in order, or exactly the first ``limit``; a long head is selected range by range."""
    if limit is not None and limit > SMALL_HEAD:
        return first_rows(rows, order, limit).orderBy(*[by.sort() for by in order])
    ordered = rows.orderBy(*[by.sort() for by in order])
    return ordered if limit is None else ordered.limit(limit)


class Answers:
    """Query layer: every method returns a DataFrame over all keys; a limit is the caller's alone.

    Methods that rank or place (percentile_ranks, profile, nearby_all, rankings without a limit)
    settle shared intermediate results when called.
    """

    def __init__(self, tables: Tables) -> None:
        self.tables = tables

    # ------------------------------------------------------------ filters and lists

    def filters(self) -> DataFrame:
        """(dimension, value) of everything one can filter by."""
        # The name table and the completed mapping hold the profiled places and areas.
        tables = self.tables
        names, mapping = tables["zip_to_neighborhood"], tables["zip_area"]
        sources = [
            ("zip_code", names, KEY),
            ("category", tables.get("business_by_zip"), "category"),
            ("area", mapping.join(names, KEY, "left_semi"), "area"),
        ]
        parts = [
            df.select(F.lit(name).alias("dimension"), F.col(column).alias("value")).distinct()
            for name, df, column in sources
            if df is not None
        ]
        spark = parts[0].sparkSession
        statuses = spark.createDataFrame([("status", "active"), ("status", "inactive")], "dimension string, value string")
        found = reduce(DataFrame.unionByName, [*parts, statuses])
        return found.filter(F.col("value").isNotNull()).orderBy("dimension", "value")

    def place_options(self) -> DataFrame:
        """Place keys with their names, in key order."""
        return self.tables["zip_to_neighborhood"].select(KEY, "neighborhood").orderBy(KEY)

    def businesses(
        self,
        zip_code: str | None = None,
        category: str | None = None,
        status: str | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """Business records meeting the given conditions, by name."""
        rows = where_equal(self.tables["businesses"], zip_code=zip_code, category=category, status=status)
        return in_order(rows, [By("business_name"), By("account_id")], limit)

    def areas(self) -> DataFrame:
        """All areas with their main figures, largest first."""
        columns = ["area", "zip_count", "population", "active_count", "businesses_per_1k", "median_income"]
        return self.tables["area_profile"].select(columns).orderBy(F.col("population").desc_nulls_last(), "area")

    def area_zips(self, area: str | None = None) -> DataFrame:
        """Places of an area (or of all areas) with their main figures, busiest first."""
        columns = [KEY, "neighborhood", "population", "active_count", "businesses_per_1k", "median_income",
                   "crime_count", "new_permits"]
        rows = self.tables["neighborhood_profile"].select("area", *columns)
        rows = where_equal(rows, area=area)
        return rows.orderBy("area", F.col("active_count").desc_nulls_last(), KEY)

    # ------------------------------------------------------------ profiles and comparisons

    def profile(self, zip_code: str | None = None) -> DataFrame:
        """Nested profile of one place, or of all."""
        rows = profiles.place_profiles(self.tables)
        return where_equal(rows, zip_code=zip_code)

    def area_profile(self, area: str | None = None) -> DataFrame:
        """Nested profile of one area, or of all."""
        return where_equal(profiles.area_profiles(self.tables), area=area)

    def compare_zips(self, pairs: DataFrame) -> DataFrame:
        """Twelve metrics side by side for each (zip_code_a, zip_code_b)."""
        return compare.head_to_head(self.tables["neighborhood_profile"], pairs, KEY)

    def compare_zips_narrative(self, pairs: DataFrame) -> DataFrame:
        """A sentence for each (zip_code_a, zip_code_b)."""
        joined = compare.place_pairs(self.tables["neighborhood_profile"], pairs, KEY)
        a, b = F.col("a"), F.col("b")
        sentence = narrative.place_pair_sentence(
            F.coalesce(a["neighborhood"], a[KEY]),
            F.coalesce(b["neighborhood"], b[KEY]),
            lambda m: a[m],
            lambda m: b[m],
        )
        return joined.select(f"{KEY}_a", f"{KEY}_b", sentence.alias("narrative"))

    def compare_areas(self, pairs: DataFrame) -> DataFrame:
        """Eleven metrics side by side for each (area_a, area_b); differences in percent of b."""
        return compare.head_to_head(
            self.tables["area_profile"], pairs, "area", fixed.AREA_COMPARISON, as_percent=True
        )

    def compare_areas_narrative(self, pairs: DataFrame) -> DataFrame:
        """A sentence for each (area_a, area_b)."""
        joined = compare.place_pairs(self.tables["area_profile"], pairs, "area")
        a, b = F.col("a"), F.col("b")
        sentence = narrative.area_pair_sentence(a["area"], b["area"], lambda m: a[m], lambda m: b[m])
        return joined.select("area_a", "area_b", sentence.alias("narrative"))

    def category_merge(self, zip_a: str, zip_b: str) -> DataFrame:
        """The top categories of two places side by side."""
        top = profiles.top_categories(self.tables)
        return compare.merged_categories(
            top.filter(F.col(KEY) == zip_a), top.filter(F.col(KEY) == zip_b)
        )

    # ------------------------------------------------------------ rankings

    def rankings(
        self, sort_by: str = "population", sort_desc: bool = True, category: str | None = None, limit: int | None = None
    ) -> DataFrame:
        """Places by a metric, optionally with one category's density as context."""
        profile = self.tables["neighborhood_profile"]
        if sort_by == "category_per_1k" and category is None:
            raise ValueError("category_per_1k requires a category")
        if sort_by == "momentum_score":
            scores = self.tables["momentum_scores"].select(KEY, "momentum_score")
            profile = profile.join(scores, KEY)
        context = ["neighborhood", *RANK_CONTEXT]
        if category is None:
            return profiles.shown(ranks.ranking(profile, sort_by, KEY, limit, sort_desc, context))
        ranked = ranks.category_ranking(
            profile, self.tables["business_by_zip"], category, sort_by, KEY, limit, sort_desc, context
        )
        return profiles.shown(ranked)

    def area_rankings(
        self, sort_by: str = "population", sort_desc: bool = True, category: str | None = None, limit: int | None = None
    ) -> DataFrame:
        """Areas by a metric, optionally with one category's count and density."""
        areas = self.tables["area_profile"]
        if sort_by == "momentum_score":
            areas = areas.join(self.tables["momentum_by_area"].select("area", "momentum_score"), "area")
        if category is None:
            nothing = {"category_active": "bigint", "category_per_1k": "double"}
            areas = areas.select("*", *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
        else:
            chosen = self.tables["area_business_by_category"].filter(F.col("category") == category)
            chosen = chosen.select(
                "area", F.col("active_count").alias("category_active"), F.col("per_1k").alias("category_per_1k")
            )
            areas = areas.join(chosen, "area", "left")
        allowed = [*[m for m in fixed.RANKING_METRICS if m != "category_count"], "category_per_1k"]
        require_metric(sort_by, allowed)
        context = [*RANK_CONTEXT, "category_active"]
        if sort_by != "category_per_1k":
            context.append("category_per_1k")
        ranked = ranks.ranking(areas, sort_by, "area", limit, sort_desc, context, allowed, keep_missing=True)
        for name in ("category_per_1k", *RANK_CONTEXT):
            if name == sort_by:
                ranked = ranked.withColumn(name, F.col("sort_value"))
        return profiles.shown(ranked.withColumn("category", F.lit(category).cast("string")))

    def named_metric(self, ranked: DataFrame, sort_by: str) -> DataFrame:
        """Display form of a ranking: the sort value under its metric's name, bookkeeping dropped."""
        rows = ranked.drop("sort_metric", "rank", "category")
        if sort_by == "category_per_1k":
            return rows
        return rows.drop(sort_by).withColumnRenamed("sort_value", sort_by)

    def percentile_ranks(self) -> DataFrame:
        """Rank and percentile of every metric of every place."""
        return profiles.place_percentiles(self.tables)

    def momentum(self, limit: int | None = None) -> DataFrame:
        """Places by growth score."""
        order = [By("momentum_score", descending=True, nulls_last=True), By(KEY)]
        return profiles.shown(in_order(self.tables["momentum_scores"], order, limit))

    def area_momentum(self, limit: int | None = None) -> DataFrame:
        """Areas by growth score."""
        order = [By("momentum_score", descending=True, nulls_last=True), By("area")]
        return profiles.shown(in_order(self.tables["momentum_by_area"], order, limit))

    def business_age(self, zip_code: str | None = None, n: int = AGE_ROWS) -> DataFrame:
        """The most common categories of a place (or of each place) with their ages."""
        return self._ages("business_age_stats", KEY, zip_code, n)

    def area_business_age(self, area: str | None = None, n: int = AGE_ROWS) -> DataFrame:
        """The most common categories of an area (or of each area) with their ages."""
        return self._ages("business_age_by_area", "area", area, n)

    def _ages(self, table: str, key: str, value: str | None, n: int) -> DataFrame:
        rows = where_equal(self.tables[table], **{key: value})
        order = [F.col("business_count").desc(), F.col("category")]
        return profiles.shown(top_n(rows, [key], order, n, "position"))

    # ------------------------------------------------------------ trends

    def zip_trends(self, zip_code: str | None = None) -> DataFrame:
        """Yearly series with change for one place, or for all."""
        rows = where_equal(self.tables["yearly_series"], zip_code=zip_code)
        return trends.with_yoy(trends.series_totals(rows, [KEY]), [KEY])

    def area_trends(self, area: str | None = None) -> DataFrame:
        """Yearly series with change for one area, or for all, summed over member places."""
        mapping = where_equal(self.tables["zip_area"], area=area)
        totals = trends.series_totals(self.tables["yearly_series"], [KEY])
        located = totals.join(mapping.select(KEY, "area"), KEY)
        return trends.with_yoy(trends.series_totals(located, ["area"]), ["area"])

    def city_trends(self) -> DataFrame:
        """Average yearly count per place with change."""
        rows = trends.with_yoy(trends.series_per_place(self.tables["yearly_series"], KEY), [])
        return profiles.shown(rows)

    # ------------------------------------------------------------ civic tables

    def services(self, limit: int | None = None) -> DataFrame:
        """Service request types by volume."""
        names = ["avg_resolution_days", "median_resolution_days", "close_rate_pct"]
        rows = self.tables["civic_311_services"].select(
            "service_name",
            "total_requests",
            "closed_requests",
            *[round_half_up(F.col(n), 1).alias(n) for n in names],
        )
        rows = rows.orderBy(F.col("total_requests").desc(), "service_name")
        return rows if limit is None else rows.limit(limit)

    def crime_detail(self, year: int | None = None) -> DataFrame:
        """Counts by offence group and kind for a year (the latest by default)."""
        return self._crime("civic_crime_detail", ["offense_group", "crime_against"], year)

    def crime_temporal(self, year: int | None = None) -> DataFrame:
        """Counts by weekday (0 = Monday), month and kind for a year (the latest by default)."""
        return self._crime("civic_crime_temporal", ["dow", "month", "crime_against"], year)

    def _crime(self, table: str, by: Sequence[str], year: int | None) -> DataFrame:
        rows = self.tables[table]
        rows = latest(rows, "year") if year is None else rows.filter(F.col("year") == year)
        return rows.groupBy(*by).agg(F.sum("count").alias("count"))

    def weekday_month_grid(self, year: int | None = None) -> DataFrame:
        """A dense 7 x 12 grid of counts, weekday rows and month columns; missing cells are 0."""
        cells = self.crime_temporal(year)
        months = list(range(1, 13))
        pivoted = cells.groupBy("dow").pivot("month", months).agg(F.sum("count"))
        days = pivoted.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
        dense = days.join(pivoted, "dow", "left").fillna(0)
        return dense.select("dow", *[F.col(str(m)).alias(f"m{m:02d}") for m in months])

    # ------------------------------------------------------------ map and market

    def centroids(self) -> DataFrame:
        """Coordinates of the profiled places."""
        return self.tables["zip_centroids"].select(KEY, "lat", "lng")

    def map_points(
        self,
        layer: str,
        zip_code: str | None = None,
        year_min: int | None = None,
        year_max: int | None = None,
        center_lat: float | None = None,
        center_lng: float | None = None,
        bbox_deg: float = geo.PLACE_BOX_DEG,
        sample: int | None = None,
        sample_by: Column | None = None,
        sample_shift: int = 48,
    ) -> DataFrame:
        """Points of a layer within years and a box around a centre or a place.

        An unknown layer gives no rows.  A layer stored along the curve (`layers.write_layer`)
        is read by the pieces of the curve that the box covers; the place's centre is then
        looked up when the method is called.  ``sample`` keeps that many points, those
        with the smallest hash; ``sample_by`` is another hash and
        ``sample_shift`` the bits below its counted ones.
        """
        if layer not in LAYERS:
            spark = self.tables["zip_to_neighborhood"].sparkSession
            return spark.createDataFrame([], "lat double, lng double")
        table, year = LAYERS[layer]
        rows = where_between(self.tables[table], year, year_min, year_max)
        if layers.CURVE in rows.columns:
            centre = (center_lat, center_lng)
            half = bbox_deg
            if None in centre and zip_code is not None:
                centre, half = geo.centre_of(self.tables["zip_centroids"], KEY, zip_code), geo.PLACE_BOX_DEG
                if None in centre:  # no box, as without the curve
                    rows = geo.within_box_of(rows, self.tables["zip_centroids"], KEY, zip_code)
            if None not in centre:
                rows = layers.in_box(rows, *[tuple(x + step for x in centre) for step in (-half, half)])
            rows = rows.drop(layers.CURVE)
        elif center_lat is not None and center_lng is not None:
            rows = geo.within_box(rows, center_lat, center_lng, bbox_deg)
        elif zip_code is not None:
            rows = geo.within_box_of(rows, self.tables["zip_centroids"], KEY, zip_code)
        if sample is None:
            return rows
        by = F.xxhash64(*rows.columns) if sample_by is None else sample_by
        return smallest(rows, by, [c for c in rows.columns if c == "point_id"], sample, sample_shift)

    def point_classes(self, points: DataFrame) -> DataFrame:
        """Permit points with their display class."""
        return points.withColumn("point_class", F.when(F.col("is_solar"), "solar").otherwise("other"))

    def area_boxes(self, default_centre: tuple[float, float]) -> DataFrame:
        """The map box covering each area."""
        return geo.view_boxes(self.tables["zip_area"], self.tables["zip_centroids"], KEY, "area", default_centre)

    def competitors(self, category: str, zip_code: str, limit: int | None = None) -> DataFrame:
        """Active businesses of a category in a place, by name."""
        rows = where_equal(self.tables["businesses"], category=category, zip_code=zip_code, status="active")
        rows = rows.select("account_id", "business_name", "address", KEY, "start_date", "status")
        return in_order(rows, [By("business_name"), By("account_id")], limit)

    def competitor_density(self, category: str | None = None, zip_code: str | None = None) -> DataFrame:
        """Active count, density and city density for each (place, category)."""
        by_zip = self.tables["business_by_zip"]
        city = counts.city_rates(by_zip, self.tables["demographics_by_zip"], KEY)
        people = self.tables["neighborhood_profile"].select(KEY, "population")
        rows = where_equal(by_zip, category=category, zip_code=zip_code)
        rows = rows.filter(F.col("category").isNotNull()).join(people, KEY, "left")
        rows = rows.join(F.broadcast(city), "category", "left")  # one row per category of the fixed list
        rate = safe_ratio(F.col("active_count") * F.lit(1000.0), F.col("population"))
        return rows.select(
            KEY,
            "category",
            F.col("active_count").alias("count"),
            F.when(F.col("population") > 0, round_half_even(rate, 2)).alias("density"),
            display_value(F.col("city_per_1k")).alias("city_avg_density"),
        )

    def _located_rates(self) -> DataFrame:
        by_zip = self.tables["business_by_zip"].filter(F.col("active_count") > 0)
        profile = self.tables["neighborhood_profile"]
        rates = counts.place_rates(by_zip, profile, KEY)
        return rates.join(profile.select(KEY, "neighborhood"), KEY)

    def nearby_competitors(
        self, category: str, zip_code: str, limit: int = NEARBY_ROWS, include_self: bool = True
    ) -> DataFrame:
        """Places near a place with active businesses of the category, most first."""
        rates = self._located_rates().filter(F.col("category") == category)
        found = geo.nearby(rates, self.tables["zip_centroids"], KEY, zip_code, include_self=include_self)
        found = found.select(KEY, "neighborhood", "active_count", "per_1k", "lat", "lng")
        shown = profiles.shown(found, but=("lat", "lng"))
        return shown.orderBy(F.col("active_count").desc(), KEY).limit(limit)

    def nearby_display(self, found: DataFrame, zip_code: str, category: str) -> DataFrame:
        """Nearby places for a map: selected flag, marker size, change against the city rate."""
        city = self.competitor_density(category).agg(F.max("city_avg_density").alias("city"))
        rows = with_row(found, city, "_city")
        rate, mean = F.col("per_1k"), F.col("_city")["city"]
        versus = (safe_ratio(rate, mean) - 1) * 100
        return rows.select(
            *found.columns,
            (F.col(KEY) == zip_code).alias("is_selected"),
            clamp(F.col("active_count") * 30, 200, 1500).cast("int").alias("radius"),
            F.coalesce(F.when((rate != 0) & (mean > 0), signed_percent_text(versus)), F.lit("—")).alias("vs_city_avg"),
        )

    def nearby_all(self, limit: int = NEARBY_ROWS) -> DataFrame:
        """For every place and category, the nearby places with most active businesses."""
        located = self._located_rates().join(self.tables["zip_centroids"], KEY)
        return geo.nearby_top(located, KEY, "active_count", ["category"], n=limit)
