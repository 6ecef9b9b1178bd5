"""Ranks, percentiles and rankings that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.classify import lookup
from civicscope.functions.numbers import per_thousand
from civicscope.operators.heads import By, first_rows
from civicscope.operators.relations import (
    SMALL_HEAD,
    numbered,
    ordered_head,
    require_metric,
    row_of,
    settled,
    skew_join,
    with_row,
)


def to_long(
    df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric"
) -> DataFrame:
    """Wide metrics to (ids, metric, value) rows with double values."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(ids), list(metrics), name, "value")


#: Distinct values of a metric that one task puts in order.
BUCKET_VALUES = 200_000
#: Parts that a crowded bucket is cut into (a power of two).
FAN_OUT = 128
#: Crowded buckets whose bounds are broadcast (1 KB each at a fan-out of 128); beyond that none of them is a hot key.
FEW_BUCKETS = 20_000


def _bounds_below(value: str, parts: int) -> Column:
    """How many of the sorted ``_bounds`` are below the value, by halving steps."""
    steps = [1 << i for i in reversed(range(parts.bit_length() - 1))]

    def take(found: Column, step: Column) -> Column:
        below = F.get(F.col("_bounds"), found + step - 1) < F.col(value)
        return found + F.when(below, step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)


def rank_buckets(
    counts: DataFrame, metric: str, value: str, most: int = BUCKET_VALUES, fan_out: int = FAN_OUT
) -> DataFrame:
    """Rows of distinct (metric, value) plus ``_bucket``, which rises with the value and holds at most ``most`` of them.

    A metric starts as one bucket.  Every bucket with too many values is cut between its own
    approximate quantiles (mergeable sketches, at most ``fan_out`` numbers per bucket), the others
    stay, until none is crowded: the number of buckets follows the distinct values, and a dense
    range is cut again however narrow it is.  Each round settles the rows and costs a count;
    metrics of at most ``most`` values need no round.
    """
    if most < 1 or fan_out < 2 or fan_out & (fan_out - 1):
        raise ValueError("most must be positive and fan_out a power of two")
    placed = settled(counts.withColumn("_bucket", F.lit(0).cast("bigint")))
    shares = F.array(*[F.lit(i / fan_out) for i in range(1, fan_out)])
    while True:
        sizes = placed.groupBy(metric, "_bucket").agg(F.count(F.lit(1)).alias("_values"))
        crowded = settled(sizes.filter(F.col("_values") > most).select(metric, "_bucket"))
        found = crowded.limit(FEW_BUCKETS + 1).count()
        if not found:
            return placed
        if found <= FEW_BUCKETS:
            crowded = F.broadcast(crowded)
        inside = placed.join(crowded, [metric, "_bucket"], "left_semi").groupBy(metric, "_bucket")
        bounds = inside.agg(F.percentile_approx(value, shares, 10_000).alias("_bounds"))
        if found <= FEW_BUCKETS:
            bounds = F.broadcast(bounds)
        part = F.when(F.col("_bounds").isNull(), 0).otherwise(_bounds_below(value, fan_out))
        cut = placed.join(bounds, [metric, "_bucket"], "left").withColumn("_bucket", F.col("_bucket") * fan_out + part)
        placed = settled(cut.select(*counts.columns, "_bucket"))


def value_positions(
    long: DataFrame, metric: str = "metric", value: str = "value", most: int = BUCKET_VALUES, fan_out: int = FAN_OUT
) -> DataFrame:
    """Per distinct value of a metric: its ties, the rows below it and all known rows.

    Equal values are counted first, so a value held by a third of the rows is one row from
    here on.  Distinct values go to buckets of bounded size (``rank_buckets``); bucket totals
    give each bucket its start, and a window inside the bucket does the rest.  The result is
    exact for any boundaries; the placed values are settled, so both readers see the same ones.
    """
    known = long.filter(F.col(value).isNotNull())
    counts = known.groupBy(metric, value).agg(F.count(F.lit(1)).alias("ties"))
    placed = rank_buckets(counts, metric, value, most, fan_out)

    totals = placed.groupBy(metric, "_bucket").agg(F.sum("ties").alias("_rows"))
    before = W.partitionBy(metric).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        metric,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(W.partitionBy(metric)).alias("known"),
    )
    inside = W.partitionBy(metric, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    # No hint: the join's exchange, by metric and bucket, is the one that the window needs anyway.
    return placed.join(totals, [metric, "_bucket"]).select(
        metric,
        value,
        "ties",
        (F.col("_start") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("below"),
        "known",
    )


def rank_long(
    long: DataFrame,
    ids: Sequence[str],
    descending: Column | bool,
    metric: str = "metric",
    value: str = "value",
    salts: int = 32,
    most: int = BUCKET_VALUES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Rows with a known value plus ``rank`` (ties share it) and ``of`` (known rows)."""
    known = settled(long.filter(F.col(value).isNotNull()))
    positions = value_positions(known, metric, value, most, fan_out)
    hot = positions.filter(F.col("ties") * 1000 > F.col("known"))
    ranked = skew_join(known, positions, [metric, value], ids, hot.select(metric, value), salts)
    down = F.lit(descending) if isinstance(descending, bool) else descending
    rank = F.when(down, F.col("known") - F.col("below") - F.col("ties")).otherwise(F.col("below"))
    return ranked.select(
        *ids,
        metric,
        value,
        (rank + 1).alias("rank"),
        F.col("known").alias("of"),
    )


def percentiles(
    long: DataFrame,
    ids: Sequence[str],
    directions: Mapping[str, bool] = fixed.PERCENTILE_METRICS,
) -> DataFrame:
    """(ids, metric, value, rank, of, percentile) for every known value of a long frame.

    percentile = 100 * (of - rank) / max(of - 1, 1), half-to-even.
    """
    flags = {m: "desc" if down else "asc" for m, down in directions.items()}
    ranked = rank_long(long, ids, lookup(flags, F.col("metric")) == F.lit("desc"))
    share = (F.col("of") - F.col("rank")) * F.lit(100.0) / F.greatest(F.col("of") - 1, F.lit(1))
    return ranked.withColumn("percentile", F.bround(share, 0).cast("int"))


def percent_ranks(
    df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str], null_policy: str = "last"
) -> DataFrame:
    """Add ascending percent ranks, (rank - 1) / (rows - 1), as metric -> new column.

    ``null_policy='last'`` ranks missing values after all known ones and counts them
    as rows; ``'neutral'`` ranks known values only and leaves missing ones NULL.
    """
    if null_policy not in ("last", "neutral"):
        raise ValueError("null_policy must be 'last' or 'neutral'")
    ranked = rank_long(to_long(df, ids, list(metrics)), ids, descending=False)
    wide = ranked.groupBy(*ids).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(name) for m, name in metrics.items()]
    )
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(m).alias(m) for m in metrics])
    joined = with_row(df.join(wide, list(ids), "left"), sizes, "_sizes")

    def share(metric: str, name: str) -> Column:
        known = F.col("_sizes")[metric]
        rows = F.col("_sizes")["rows"] if null_policy == "last" else known
        missing = known if null_policy == "last" else F.lit(None).cast("bigint")
        behind = F.coalesce(F.col(name).cast("bigint") - 1, missing)
        return F.when(rows > 1, behind / (rows - 1)).when(behind.isNotNull(), F.lit(0.0))

    return joined.select(*df.columns, *[share(m, n).alias(n) for m, n in metrics.items()])


def ranking(
    df: DataFrame,
    metric: str,
    key: str,
    limit: int | None,
    descending: bool = True,
    context: Sequence[str] = (),
    allowed: Sequence[str] = fixed.RANKING_METRICS,
    keep_missing: bool = False,
) -> DataFrame:
    """The first ``limit`` rows (all without one) by a metric, enumerated; ties go by key."""
    require_metric(metric, allowed)
    rows = df if keep_missing else df.filter(F.col(metric).isNotNull())
    rows = rows.select(
        key, F.col(metric).alias("sort_value"), *[c for c in context if c not in (key, metric)]
    )
    order = [By("sort_value", descending, nulls_last=True), By(key)]
    columns = [by.sort() for by in order]
    if limit is not None and limit > SMALL_HEAD:
        head = numbered(first_rows(rows, order, limit), columns, "rank").withColumn("rank", F.col("rank").cast("int"))
    else:
        head = ordered_head(rows, columns, limit, "rank")
    return head.withColumn("sort_metric", F.lit(metric))


def category_ranking(
    df: DataFrame,
    counts: DataFrame,
    category: str,
    metric: str,
    key: str,
    limit: int | None,
    descending: bool = True,
    context: Sequence[str] = (),
    allowed: Sequence[str] = fixed.RANKING_METRICS,
    keep_missing: bool = False,
) -> DataFrame:
    """A ranking with one category's active count and rate per 1,000 as context.

    ``metric='category_per_1k'`` sorts by that rate.  ``counts`` holds one row per
    (key, category) with ``active_count``.
    """
    chosen = counts.filter(F.col("category") == category).select(
        key, F.col("active_count").alias("category_active")
    )
    joined = df.join(chosen, key, "left").withColumn(
        "category_active", F.coalesce("category_active", F.lit(0).cast("bigint"))
    )
    rate = F.when(
        F.col("population") > 0, per_thousand(F.col("category_active"), F.col("population"), 2)
    )
    joined = joined.withColumn("category_per_1k", rate)
    by_rate = metric == "category_per_1k"
    extra = ["category_active", *context] if by_rate else ["category_active", "category_per_1k", *context]
    ranked = ranking(
        joined,
        metric,
        key,
        limit,
        descending,
        extra,
        [*allowed, "category_per_1k"],
        keep_missing=by_rate or keep_missing,
    )
    if by_rate:
        ranked = ranked.withColumn("category_per_1k", F.col("sort_value"))
    return ranked.withColumn("category", F.lit(category))
