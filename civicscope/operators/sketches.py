"""Opt-in distinct counts and medians that roll up: sketches per cell, merged without the facts.

A distinct count or a median of an area does not follow from those of its places.  Sketches do
merge: they are made in one pass over the facts, stored, extended by those of new facts, and every
coarser answer reads the sketches only.  The exact counterparts stay the default elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions.numbers import round_half_up
from civicscope.operators.counts import DAYS_PER_YEAR

#: Logarithm of the registers of a distinct sketch: at most 4 KB each, a few bytes while it holds few values.
LG_K = 12
#: Size of a quantile sketch: a few KB however many values it has seen.
K = 200


def distinct_bound(lg_k: int = LG_K) -> float:
    """Largest relative error of a merged distinct estimate: four standard errors."""
    return 4 * 1.04 / (2**lg_k) ** 0.5


def rank_bound(k: int = K) -> float:
    """Largest rank error of a merged quantile, as a share of the values: twice the bound of 99 % confidence."""
    return 2 * 2.296 / k**0.9723


def business_sketches(
    businesses: DataFrame, by: Sequence[str], distinct: str = "business_name", lg_k: int = LG_K, k: int = K
) -> DataFrame:
    """Per group: a sketch of the distinct values of a column, and one of the start dates of active businesses.

    Null values and dates are not counted; a group without any has empty sketches.  What travels are
    sketches made on the map side, so a hot group costs as much as any other.
    """
    started = F.when(F.col("status") == "active", F.unix_date("start_date").cast("bigint"))
    return businesses.groupBy(*by).agg(
        F.hll_sketch_agg(F.col(distinct), F.lit(lg_k)).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(started, F.lit(k)).alias("start_sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups (one row for no columns), or of several loads of the same groups."""
    return sketches.groupBy(*by).agg(
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_bigint("start_sketch").alias("start_sketch"),
    )


def estimates(sketches: DataFrame, as_of: Column) -> DataFrame:
    """The groups with ``distinct_estimate``, ``start_count`` (exact), ``median_start`` and ``median_age_years``.

    The distinct estimate is within ``distinct_bound`` of the exact count; the share of starts before
    ``median_start`` is within ``rank_bound`` of one half.  Without starts the median is null.
    """
    number = F.kll_sketch_get_n_bigint("start_sketch")
    day = F.when(F.col("start_count") > 0, F.kll_sketch_get_quantile_bigint(F.col("start_sketch"), F.lit(0.5)))
    told = sketches.withColumn("distinct_estimate", F.hll_sketch_estimate("distinct_sketch"))
    told = told.withColumn("start_count", number).withColumn("median_start", F.date_from_unix_date(day.cast("int")))
    age = F.datediff(as_of, F.col("median_start")) / F.lit(DAYS_PER_YEAR)
    return told.withColumn("median_age_years", round_half_up(age, 1)).drop("distinct_sketch", "start_sketch")


def rank_errors(histogram: DataFrame, medians: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rank_error): how far ``median_start`` is from the middle of the exact order, as a share of the rows.

    ``histogram`` holds ``n`` rows per group and ``start_date``; a date that many rows share covers
    all of their ranks.
    """
    if by:
        joined = histogram.join(medians.select(*by, "median_start"), list(by))
    else:
        joined = histogram.withColumn("median_start", medians.select("median_start").scalar())
    below = F.sum(F.when(F.col("start_date") < F.col("median_start"), F.col("n")).otherwise(0))
    upto = F.sum(F.when(F.col("start_date") <= F.col("median_start"), F.col("n")).otherwise(0))
    error = F.greatest(below / F.sum("n") - 0.5, F.lit(0.5) - upto / F.sum("n"), F.lit(0.0))
    return joined.groupBy(*by).agg(error.alias("rank_error"))
