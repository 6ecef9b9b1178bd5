"""Comparisons: place against the average, place against place, list against list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.classify import lookup
from civicscope.functions.numbers import display_value, percent_change, round_half_even
from civicscope.operators.relations import merge_counts, with_row


def metric_rows(
    df: DataFrame, ids: Sequence[str], entries: Mapping[str, tuple[Column, Column]], names: tuple[str, str]
) -> DataFrame:
    """One row per (ids, metric) with two double columns."""
    packed = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                first.cast("double").alias(names[0]),
                second.cast("double").alias(names[1]),
            )
            for metric, (first, second) in entries.items()
        ]
    )
    return df.select(*ids, F.explode(packed).alias("_m")).select(*ids, "_m.*")


def versus_average(
    profiles: DataFrame,
    averages: DataFrame,
    key: str,
    pairs: Mapping[str, str] = fixed.AVERAGE_OF,
) -> DataFrame:
    """(key, metric, value, city_avg, vs_avg_pct) for each comparable metric."""
    rows = with_row(profiles, averages, "_avg")
    entries = {m: (F.col(m), F.col("_avg")[a]) for m, a in pairs.items()}
    rows = metric_rows(rows, [key], entries, ("value", "city_avg"))
    rows = rows.withColumn("_pct", percent_change(F.col("value"), F.col("city_avg")))
    return rows.filter(F.col("_pct").isNotNull()).select(
        key,
        "metric",
        display_value(F.col("value")).alias("value"),
        display_value(F.col("city_avg")).alias("city_avg"),
        round_half_even(F.col("_pct"), 1).alias("vs_avg_pct"),
    )


def place_pairs(profiles: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The two profile rows of each pair as structs ``a`` and ``b``."""
    row = F.struct(*profiles.columns)
    left = profiles.select(F.col(key).alias(f"{key}_a"), row.alias("a"))
    right = profiles.select(F.col(key).alias(f"{key}_b"), row.alias("b"))
    return pairs.join(left, f"{key}_a").join(right, f"{key}_b")


def head_to_head(
    profiles: DataFrame,
    pairs: DataFrame,
    key: str,
    metrics: Sequence[str] = fixed.PLACE_COMPARISON,
    as_percent: bool = False,
) -> DataFrame:
    """(pair, metric, value_a, value_b, difference): a - b, or percent of b."""

    ids = [f"{key}_a", f"{key}_b"]
    entries = {m: (F.col("a")[m], F.col("b")[m]) for m in metrics}
    rows = metric_rows(place_pairs(profiles, pairs, key), ids, entries, ("value_a", "value_b"))
    a, b = F.col("value_a"), F.col("value_b")
    shown = rows.withColumns({"value_a": display_value(a), "value_b": display_value(b)})
    shown = shown.withColumn("_difference", percent_change(a, b) if as_percent else a - b)
    difference = round_half_even(F.col("_difference"), 1).alias("difference")
    return shown.select(*ids, "metric", "value_a", "value_b", difference)


def winner(value_a: Column, value_b: Column, sense: Column) -> Column:
    """'a', 'b' or '' by the metric's sense (good, bad, neutral)."""
    higher = F.when(value_a > value_b, "a").when(value_a < value_b, "b")
    lower = F.when(value_a < value_b, "a").when(value_a > value_b, "b")
    return F.coalesce(F.when(sense == "good", higher).when(sense == "bad", lower), F.lit(""))


def with_winner(rows: DataFrame, senses: Mapping[str, str] = fixed.COMPARISON_SENSE) -> DataFrame:
    """Add the winner of each head-to-head row."""
    sense = lookup(senses, F.col("metric"))
    return rows.withColumn("winner", winner(F.col("value_a"), F.col("value_b"), sense))


def merged_categories(
    left: DataFrame, right: DataFrame, names: tuple[str, str] = ("count_a", "count_b"), n: int = 15
) -> DataFrame:
    """Two category lists side by side, the n largest by their sum."""
    merged = merge_counts(left, right, ["category"], "active_count", names)
    total = F.col(names[0]) + F.col(names[1])
    return merged.orderBy(total.desc(), F.col("category")).limit(n)
