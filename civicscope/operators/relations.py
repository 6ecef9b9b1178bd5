"""Filters, look-ups, top-n and joins shared by the other operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# ---------------------------------------------------------------- columns


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """First candidate present in the frame, compared without regard to case."""
    present = {name.lower(): name for name in df.columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def column_or(df: DataFrame, candidates: Sequence[str], default: object, dtype: str) -> Column:
    """The first candidate column, or a typed literal when none is present."""
    name = find_column(df, *candidates)
    column = F.lit(default) if name is None else df[f"`{name}`"]
    return column.cast(dtype)


def require_metric(metric: str, allowed: Iterable[str]) -> str:
    """Refuse a metric name outside the allowed list before it reaches a plan."""
    names = sorted(allowed)
    if metric not in names:
        raise ValueError(f"invalid metric: {metric}. allowed: {names}")
    return metric


def typed_nulls(columns: Mapping[str, str]) -> list[Column]:
    """NULL columns standing for an absent optional input."""
    return [F.lit(None).cast(dtype).alias(name) for name, dtype in columns.items()]


# ---------------------------------------------------------------- filters


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """AND of the equality conditions whose value is given; None means no condition."""
    tests = [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def where_between(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """Range filter with optional ends."""
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high))
    return df


def having_key_in(df: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Rows whose key appears in any of the other frames."""
    keys = reduce(DataFrame.unionByName, [o.select(on) for o in others])
    return df.join(keys.filter(F.col(on).isNotNull()).distinct(), on, "left_semi")


def lacking_key_in(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows with a known key that the other frame does not have.

    SQL ``NOT IN`` returns nothing once the other side holds a NULL; here NULL keys
    of the other side are ignored, and rows with a NULL key are dropped as in SQL.
    """
    known = other.select(on).filter(F.col(on).isNotNull())
    return df.filter(F.col(on).isNotNull()).join(known, on, "left_anti")


def complete_mapping(
    mapping: DataFrame, universe: DataFrame, key: str, value: str, default: str = "Other"
) -> DataFrame:
    """The mapping plus a default entry for every key of the universe it lacks."""
    missing = lacking_key_in(universe.select(key).distinct(), mapping, key)
    return mapping.select(key, value).unionByName(missing.withColumn(value, F.lit(default)))


# ---------------------------------------------------------------- one-row inputs


def row_of(one_row: DataFrame) -> Column:
    """A one-row frame as a struct column, evaluated once as a scalar subquery."""
    return one_row.select(F.struct(*one_row.columns).alias("row")).scalar()


def with_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row frame to every row as a struct column (no join)."""
    return df.withColumn(name, row_of(one_row))


def settled(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint.

    For results read several times: the work behind them runs once, and a lost
    executor costs a re-read, not a rebuild.  The folder is the one the cluster
    names in ``spark.checkpoint.dir``; only a local session without it gets its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="civicscope-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")


# ---------------------------------------------------------------- latest and top rows


def latest(
    df: DataFrame,
    period: str,
    by: Sequence[str] = (),
    qualifying: Column | None = None,
) -> DataFrame:
    """Rows of the latest period, overall or per key (one pass; meant for aggregated rows).

    ``qualifying`` restricts both the search for the latest period and the result.
    """
    rows = df if qualifying is None else df.filter(qualifying)
    if not by:
        return rows.filter(F.col(period) == rows.agg(F.max(period)).scalar())
    newest = F.max(period).over(W.partitionBy(*by))
    return rows.withColumn("_newest", newest).filter(F.col(period) == F.col("_newest")).drop("_newest")


def latest_row(df: DataFrame, by: Sequence[str], period: str, keep: Sequence[str]) -> DataFrame:
    """One row per key: the values at its greatest period (partial aggregation, no window)."""
    newest = df.groupBy(*by).agg(F.max_by(F.struct(period, *keep), period).alias("_row"))
    return newest.select(*by, "_row.*")


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, position: str | None = None
) -> DataFrame:
    """First n rows per key.

    The row-number filter lets Spark cut every key to n rows before the shuffle, so
    a hot key never moves whole into one task.
    """
    rank = position or "_position"
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    ranked = ranked.filter(F.col(rank) <= n)
    return ranked if position else ranked.drop(rank)


#: Heads up to this length are merged in one task; longer ones are numbered by ranges.
SMALL_HEAD = 5_000


def ordered_head(df: DataFrame, order: Sequence[Column], n: int | None, position: str) -> DataFrame:
    """First n rows of the whole frame (all without n), numbered 1..n: int with a limit, else long."""
    if n is not None and n <= SMALL_HEAD:
        head = df.orderBy(*order).limit(n)
        return head.withColumn(position, F.row_number().over(W.orderBy(*order)))
    rows = numbered(df, order, position)
    return rows if n is None else rows.filter(F.col(position) <= n).withColumn(position, F.col(position).cast("int"))


def numbered(df: DataFrame, order: Sequence[Column], position: str) -> DataFrame:
    """All rows numbered from 1 (long) in the given order: each range of the order in its own task."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    placed = ranged.join(F.broadcast(starts), "_range").withColumn(position, F.col("_start") + inside)
    return placed.drop("_range", "_start")


def smallest(df: DataFrame, by: Column, ties: Sequence[str], n: int, shift: int = 48) -> DataFrame:
    """The n rows with the smallest ``by`` (a long, hash-like; then by ``ties``), as a repeatable sample.

    Rows are counted by the upper bits of ``by``; whole buckets below the cut stay,
    and only the bucket that holds the cut is ordered.  There are at most
    2 ** (bits of ``by`` - shift) buckets.
    """
    marked = df.withColumn("_by", by).withColumn("_bucket", F.shiftright("_by", shift))
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.select("_bucket", F.sum("_n").over(W.orderBy("_bucket")).alias("_end"), "_n")
    open_ended = ends.filter(F.col("_end") - F.col("_n") < n).select("_bucket", (F.lit(n) - F.col("_end") + F.col("_n")).alias("_room"), "_n")
    kept = marked.join(F.broadcast(open_ended), "_bucket")
    whole = kept.filter(F.col("_n") <= F.col("_room"))
    cut = top_n(kept.filter(F.col("_n") > F.col("_room")), ["_bucket"], [F.col("_by"), *[F.col(c) for c in ties]], n, "_place")
    return whole.unionByName(cut.filter(F.col("_place") <= F.col("_room")).drop("_place")).select(*df.columns)


def collect_top(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, fields: Sequence[str], name: str
) -> DataFrame:
    """First n rows per key as one array of structs in order."""
    rows = top_n(df, by, order, n, "_position")
    packed = F.sort_array(F.collect_list(F.struct("_position", *fields)))
    shaped = F.transform(packed, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return rows.groupBy(*by).agg(shaped.alias(name))


# ---------------------------------------------------------------- joins


def hot_keys(df: DataFrame, on: Sequence[str], share: int = 1000) -> DataFrame:
    """Keys holding more than one in ``share`` of all rows.

    By counting there are fewer than ``share`` of them, so they may be broadcast.
    """
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t")).select("t").scalar()
    return sizes.filter(F.col("_n") * share > total).select(*on)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    hot: DataFrame,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Equi-join for a left side with hot keys and a right side with few rows per key.

    Left rows of a hot key are spread over ``salts`` tasks by a hash of ``spread``
    and the right rows of that key copied as often; other keys join as they are.
    """
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    bucket = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = left.join(flag, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot"), bucket).otherwise(F.lit(0))
    )
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(flag, list(on), "left").withColumn("_salt", F.explode(every))
    return salted.drop("_hot").join(copies.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def merge_counts(
    left: DataFrame, right: DataFrame, on: Sequence[str], count: str, names: tuple[str, str]
) -> DataFrame:
    """Full-outer merge of two count lists; a missing side counts 0."""
    a = left.select(*on, F.col(count).alias(names[0]))
    b = right.select(*on, F.col(count).alias(names[1]))
    return a.join(b, list(on), "full_outer").fillna(0, list(names))
