"""The exact first n rows in any order, for any n, without gathering n rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicscope.operators.relations import row_of, smallest

#: Sampled keys that cut the order into ranges (collected: so many rows of the order's columns).
SPLITTERS = 256
#: A range of at most so many rows is ordered in one task.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class By:
    """One column of an order."""

    column: str
    descending: bool = False
    nulls_last: bool = False

    def sort(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def before(self, a: Column, b: Column) -> Column:
        """Whether a stands strictly before b; never null."""
        less = F.coalesce(a > b if self.descending else a < b, F.lit(False))
        first, last = (b, a) if self.nulls_last else (a, b)
        return less | (first.isNull() & last.isNotNull())


def _before(order: Sequence[By], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Lexicographic: strictly before."""
    out = F.lit(False)
    for by, x, y in reversed(list(zip(order, a, b))):
        out = by.before(x, y) | (x.eqNullSafe(y) & out)
    return out


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, [x.eqNullSafe(y) for x, y in zip(a, b)])


def _own(order: Sequence[By]) -> list[Column]:
    return [F.col(f"`{by.column}`") for by in order]


def _splitters(rows: DataFrame, order: Sequence[By], n: int) -> DataFrame:
    """One row with the array ``keys``: at most n different sampled keys in order."""
    keys = rows.select(*_own(order))
    sample = keys.withColumn("_chance", F.rand(7)).orderBy("_chance").limit(n).select(*_own(order)).distinct()
    found = sample.orderBy(*[by.sort() for by in order]).collect()
    spark, schema = rows.sparkSession, keys.schema
    listed = spark.createDataFrame(found, schema).select(F.struct(*_own(order)).alias("key"), F.monotonically_increasing_id().alias("at"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda r: r["key"])
    return listed.coalesce(1).agg(packed.alias("keys"))


def _at(order: Sequence[By], splitters: Column, size: int) -> Column:
    """2 k for a row between splitters k - 1 and k, 2 k + 1 for a row equal to splitter k."""
    own = _own(order)

    def key(i: Column) -> list[Column]:
        found = F.get(splitters, i)
        return [found[by.column] for by in order]

    steps = [1 << i for i in reversed(range(max(1, size.bit_length())))]

    def take(found: Column, step: Column) -> Column:
        # Splitter found + step - 1 stands before the row: so do all up to it.
        here = (found + step <= size) & _before(order, key(found + step - 1), own)
        return found + F.when(here, step).otherwise(0)

    passed = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)
    return F.get(F.transform(F.array(passed), lambda k: k * 2 + F.when((k < size) & _same(key(k), own), 1).otherwise(0)), F.lit(0))


def first_rows(df: DataFrame, order: Sequence[By], n: int, splitters: int = SPLITTERS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exactly the first n rows of ``df`` in the given order (all if it has fewer), themselves in no order.

    Sampled keys cut the order into ranges and the rows of each are counted.  Ranges wholly below
    the cut are kept by a filter; the range that holds the cut is cut again in the same way until
    it is small, then ordered.  Rows equal to a splitter are a range of their own, so a key that
    many rows share does not stop this; of rows equal in the whole order those with the smallest
    hash are taken.  ``df`` is read twice per round (order's columns only) and once for the result;
    what reaches the driver are ``splitters`` keys and counts per round.  Columns ``_keys``, ``_at``
    and ``_place`` must be free.
    """
    if n <= 0:
        return df.limit(0)
    whole: list[DataFrame] = []
    rows, room = df, n
    while True:
        keys = _splitters(rows, order, splitters)
        size = len(keys.first()["keys"])
        if not size:  # no rows
            break
        marked = rows.withColumn("_keys", row_of(keys)["keys"]).withColumn("_at", _at(order, F.col("_keys"), size)).drop("_keys")
        sizes = dict(marked.groupBy("_at").count().collect())
        before, cut = 0, None
        for at in sorted(sizes):
            if before + sizes[at] > room:
                cut = at
                break
            before += sizes[at]
        below = marked if cut is None else marked.filter(F.col("_at") < cut)
        whole.append(below.drop("_at"))
        if cut is None or before == room:
            break
        room -= before
        rows = marked.filter(F.col("_at") == cut).drop("_at")
        if cut % 2:
            whole.append(smallest(rows, F.xxhash64(*rows.columns), [], room))
            break
        if sizes[cut] <= range_rows:
            place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*[by.sort() for by in order]))
            whole.append(rows.withColumn("_place", place).filter(F.col("_place") <= room).drop("_place"))
            break
    return reduce(DataFrame.unionByName, whole) if whole else df.limit(0)
