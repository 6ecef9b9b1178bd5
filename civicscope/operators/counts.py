"""Counts, densities, ages and averages of the business table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions.numbers import per_thousand, round_half_up, safe_ratio, share_percent
from civicscope.operators.relations import row_of

# An age year in days, and the limits of "young" and "old" in days.
DAYS_PER_YEAR = 365.25
YOUNG_DAYS = 730
OLD_DAYS = 3652
#: Rows of stored cubes that one task adds up, about.
CUBE_ROWS = 1 << 18


def category_counts(
    businesses: DataFrame, by: Sequence[str], status: str = "status", active: str = "active"
) -> DataFrame:
    """Rows and active rows per group."""
    return businesses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col(status) == active).alias("active_count"),
    )


def business_cube(businesses: DataFrame, key: str, category: str = "category") -> DataFrame:
    """Businesses per (place, category, status, start date): the only pass over their rows.

    Cells, formation and start histogram follow from it, and cubes of disjoint sets of
    businesses add up (``merged_cube``), so new businesses need no second look at old ones.
    """
    return businesses.groupBy(key, category, "status", "start_date").agg(F.count(F.lit(1)).alias("n"))


def merged_cube(cubes: DataFrame, key: str, category: str = "category") -> DataFrame:
    """One cube from the rows of several, about ``CUBE_ROWS`` of them to a task.

    Most rows are groups of their own, so a task's state is as large as what it reads: their number, not their
    compressed bytes, decides how many tasks there are.  The rows are counted first, which is cheap for stored cubes.
    """
    by = [key, category, "status", "start_date"]
    dealt = cubes.repartition(max(1, -(-cubes.count() // CUBE_ROWS)), *by)
    return dealt.groupBy(*by).agg(F.sum("n").alias("n"))


def _number(n: str | None, condition: Column | None = None) -> Column:
    """Rows that meet the condition, or the sum of their ``n`` when rows are counts."""
    if n is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return F.sum(n) if condition is None else F.sum(F.when(condition, F.col(n)).otherwise(0))


def business_cells(rows: DataFrame, key: str, category: str = "category", n: str | None = None) -> DataFrame:
    """One row per (place, category) from businesses, or from a cube with its count column ``n``."""
    return rows.groupBy(key, category).agg(
        _number(n).alias("total_count"),
        _number(n, F.col("status") == "active").alias("active_count"),
        F.min("start_date").alias("earliest_start"),
        F.max("start_date").alias("latest_start"),
    )


def place_summary(cells: DataFrame, key: str, category: str = "category") -> DataFrame:
    """Totals, active rows, distinct categories, first and last start per place.

    The cells already hold each category once, so the distinct count is a plain count.
    """
    return cells.groupBy(key).agg(
        F.sum("total_count").alias("total_count"),
        F.sum("active_count").alias("active_count"),
        F.count(category).alias("category_count"),
        F.min("earliest_start").alias("earliest_start"),
        F.max("latest_start").alias("latest_start"),
    )


def formation(rows: DataFrame, key: str, first_year: int = 2015, n: str | None = None) -> DataFrame:
    """Businesses started per place and year, from ``first_year`` on; ``n`` as in ``business_cells``."""
    year = F.year("start_date")
    started = rows.filter(F.col("start_date").isNotNull() & (year >= first_year))
    return started.groupBy(key, year.alias("year")).agg(_number(n).alias("new_businesses"))


def start_histogram(rows: DataFrame, by: Sequence[str], n: str | None = None) -> DataFrame:
    """Active businesses per group and start date, the shared input of age statistics; ``n`` as in ``business_cells``."""
    active = rows.filter(F.col("start_date").isNotNull() & (F.col("status") == "active"))
    return active.groupBy(*by, "start_date").agg(_number(n).alias("n"))


def age_statistics(
    histogram: DataFrame,
    by: Sequence[str],
    as_of: Column,
    at_least: int = 3,
) -> DataFrame:
    """Median and mean age in years, shares of young and old, per group of enough rows.

    The exact median runs over day counts weighted by frequency, so a group's state
    is bounded by the number of distinct dates, not by its rows.
    """
    days = F.datediff(as_of, F.col("start_date"))
    aged = histogram.withColumn("_days", days)
    count = F.sum("n")
    median = F.percentile(F.col("_days"), 0.5, F.col("n"))
    mean = F.sum(F.col("_days") * F.col("n")) / count
    stats = aged.groupBy(*by).agg(
        count.alias("business_count"),
        round_half_up(median / F.lit(DAYS_PER_YEAR), 1).alias("median_age_years"),
        round_half_up(mean / F.lit(DAYS_PER_YEAR), 1).alias("avg_age_years"),
        share_percent(F.col("_days") < YOUNG_DAYS, 1, F.col("n")).alias("pct_under_2yr"),
        share_percent(F.col("_days") > OLD_DAYS, 1, F.col("n")).alias("pct_over_10yr"),
    )
    return stats.filter(F.col("business_count") >= at_least)


def city_rates(counts: DataFrame, population: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Per category: active businesses over all places of the universe per 1,000 of its residents.

    The universe is the ``population`` frame; places outside it do not count.
    """
    total = population.agg(F.sum("population").alias("p")).select("p").scalar()
    inside = counts.join(population.select(key).distinct(), key, "left_semi")
    sums = inside.groupBy("category").agg(F.sum("active_count").alias("active"))
    rate = round_half_up(safe_ratio(F.col("active") * F.lit(1000.0), total), digits)
    return sums.select("category", rate.alias("city_per_1k"))


def place_rates(
    counts: DataFrame, profiles: DataFrame, key: str, digits: int = 2
) -> DataFrame:
    """Active businesses per 1,000 residents for each (place, category)."""
    joined = counts.join(profiles.select(key, "population"), key)
    rate = F.when(
        F.col("population") > 0, per_thousand(F.col("active_count"), F.col("population"), digits)
    )
    return joined.select(key, "category", "active_count", rate.alias("per_1k"))


def city_averages(
    demographics: DataFrame | None,
    summary: DataFrame | None,
    profiles: DataFrame | None,
    key: str,
) -> DataFrame | None:
    """One row of per-place averages; absent inputs give NULL columns.

    Business averages cover only places with demographics when those are given;
    the density is a mean of ratios.
    """
    demographic = ["population", "median_age", "median_income", "median_home_value", "median_rent",
                   "pct_bachelors_plus"]
    business = {"active_count": "avg_active_businesses", "total_count": "avg_total_businesses",
                "category_count": "avg_category_count"}
    civic = ["crime_count", "median_311_days", "new_permits", "solar_installs"]

    if demographics is None and summary is None:
        return None
    if demographics is not None:
        base = demographics.agg(*[F.avg(c).alias(f"avg_{c}") for c in demographic])
    else:
        base = summary.agg(*[F.max(F.lit(None).cast("double")).alias(f"avg_{c}") for c in demographic])

    if summary is not None:
        counted = summary
        if demographics is not None:
            counted = summary.join(demographics.select(key), key, "left_semi")
        base = base.withColumn(
            "_b", row_of(counted.agg(*[F.avg(c).alias(n) for c, n in business.items()]))
        )
        base = base.select("*", "_b.*").drop("_b")
    else:
        base = base.select("*", *[F.lit(None).cast("double").alias(n) for n in business.values()])

    density = "avg_businesses_per_1k"
    if profiles is not None:
        ratio = F.when(
            F.col("population") > 0, F.col("active_count") * F.lit(1000.0) / F.col("population")
        )
        if summary is None or demographics is None:
            ratio = F.lit(None).cast("double")
        civic_row = profiles.agg(
            round_half_up(F.avg(ratio), 1).alias(density),
            *[F.avg(c).alias(f"avg_{c}") for c in civic],
        )
        base = base.withColumn("_c", row_of(civic_row)).select("*", "_c.*").drop("_c")
    else:
        names = [density, *[f"avg_{c}" for c in civic]]
        base = base.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    return base
