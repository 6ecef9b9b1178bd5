"""Yearly series, year-over-year change and growth momentum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicscope.functions.numbers import (
    percent_change,
    round_half_even,
    round_half_up,
    safe_ratio,
    weighted_mean,
)
from civicscope.operators.ranks import percent_ranks
from civicscope.operators.relations import having_key_in, latest_row, settled

# The four series of a growth score and their output columns.
MOMENTUM_SERIES = {
    "business_formation": "biz_formation_yoy",
    "permits": "permit_yoy",
    "crime": "crime_yoy",
    "solar": "solar_yoy",
}


def yearly_series(
    sources: Mapping[str, tuple[DataFrame, str]], key: str, year: str = "year"
) -> DataFrame:
    """Long (key, series, year, count) rows of several yearly count tables."""
    parts = [
        df.select(
            F.col(key),
            F.lit(name).alias("series"),
            F.col(year).cast("int").alias("year"),
            F.col(count).cast("bigint").alias("count"),
        )
        for name, (df, count) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def series_totals(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of counts per key, series and year."""
    return long.groupBy(*by, "series", "year").agg(F.sum("count").alias("count"))


def series_per_place(long: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Average count per distinct key for each series and year."""
    per_key = series_totals(long, [key])
    mean = F.sum("count") * F.lit(1.0) / F.count(key)
    return per_key.groupBy("series", "year").agg(round_half_up(mean, digits).alias("count"))


def with_yoy(series: DataFrame, by: Sequence[str], dense_years: bool = False) -> DataFrame:
    """Add ``yoy_pct``, the change against the previous row of the series.

    ``dense_years`` compares only with the directly preceding year.
    """
    order = W.partitionBy(*by, "series").orderBy("year")
    previous = F.lag("count").over(order)
    if dense_years:
        previous = F.when(F.lag("year").over(order) == F.col("year") - 1, previous)
    changed = series.withColumn("_previous", previous)
    changed = changed.withColumn("_pct", percent_change(F.col("count"), F.col("_previous")))
    return changed.select(*series.columns, round_half_even(F.col("_pct"), 1).alias("yoy_pct"))


def latest_yoy(with_change: DataFrame, by: Sequence[str]) -> DataFrame:
    """Newest year of each series with its change."""
    return latest_row(with_change, [*by, "series"], "year", ["count", "yoy_pct"])


def year_span(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """First and last year of each series."""
    return series.groupBy(*by, "series").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


# ---------------------------------------------------------------- momentum


def two_year_change(
    long: DataFrame,
    key: str,
    previous_year: int,
    current_year: int,
    inverted: Sequence[str] = ("crime",),
    columns: Mapping[str, str] = MOMENTUM_SERIES,
) -> DataFrame:
    """Percent change between two years per key, one column per series.

    All series come out of a single aggregation.  A falling inverted series counts
    as growth.  Keys with nothing in either year are dropped.
    """

    def total(series: str, year: int) -> Column:
        here = (F.col("series") == series) & (F.col("year") == year)
        return F.sum(F.when(here, F.col("count")).otherwise(F.lit(0)))

    sums = []
    for i, series in enumerate(columns):
        sums += [total(series, previous_year).alias(f"_p{i}"), total(series, current_year).alias(f"_c{i}")]
    rows = long.filter(F.col("year").isin(previous_year, current_year)).groupBy(key).agg(*sums)
    any_growth = reduce(
        lambda a, b: a | b, [(F.col(f"_{s}{i}") > 0) for i in range(len(columns)) for s in "pc"]
    )
    changes = []
    for i, (series, name) in enumerate(columns.items()):
        before, now = F.col(f"_p{i}"), F.col(f"_c{i}")
        factor = F.lit(-100.0 if series in inverted else 100.0)
        change = round_half_up(safe_ratio((now - before) * factor, before), 1)
        changes.append(F.when(before > 0, change).alias(name))
    return rows.filter(any_growth).select(key, *changes)


def momentum(
    long: DataFrame,
    universe: DataFrame,
    key: str,
    previous_year: int,
    current_year: int,
    null_policy: str = "last",
    columns: Mapping[str, str] = MOMENTUM_SERIES,
) -> DataFrame:
    """Growth score of 0-100 per key: 25 points times the percent rank of each change.

    ``null_policy='last'`` scores a missing change above every known one;
    ``'neutral'`` gives it half of the points.
    """
    points = 100.0 / len(columns)
    changes = two_year_change(long, key, previous_year, current_year, columns=columns)
    changes = settled(having_key_in(changes, universe, on=key))
    names = list(columns.values())
    ranked = percent_ranks(changes, [key], {n: f"_{n}" for n in names}, null_policy)
    score = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.col(f"_{n}") * F.lit(points), F.lit(points / 2)) for n in names],
    )
    return ranked.select(key, round_half_up(score, 1).alias("momentum_score"), *names)


def momentum_by_group(
    scores: DataFrame,
    weights: DataFrame,
    mapping: DataFrame,
    key: str,
    group: str,
    weight: str = "population",
    columns: Mapping[str, str] = MOMENTUM_SERIES,
) -> DataFrame:
    """Population-weighted scores and changes per group.

    The score keeps every weight in its denominator, the changes only known ones.
    """
    w = F.col(weight).cast("double")
    joined = scores.join(weights.select(key, weight), key).join(mapping.select(key, group), key)
    return joined.filter(F.col(group).isNotNull()).groupBy(group).agg(
        weighted_mean(F.col("momentum_score"), w, 1).alias("momentum_score"),
        *[
            weighted_mean(F.col(n), w, 1, skip_null_weight=True).alias(n)
            for n in columns.values()
        ],
    )
