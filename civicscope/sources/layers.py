"""Point layers stored along a space-filling curve, so that a box reads only its surroundings.

The curve key interleaves the bits of a point's grid row and column.  A layer is range-clustered
and sorted by it, so each file and each row group covers a short piece of the curve, which is a
compact region.  A box is cut into at most ``PIECES`` pieces of the curve; these go to the Parquet
reader as plain ranges, and the exact test on the coordinates follows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column that holds the key.
CURVE = "curve"
#: Bits of the row and of the column: cells of about a metre.
BITS = 24
#: Ranges of the curve that a box becomes at most.
PIECES = 32
#: Rows of a row group: what a small box reads at least.
GROUP_ROWS = 20_000

# Masks that move the bits of a number to every second place.
_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_CELLS = 1 << BITS


def _cell(value: Column, low: float, span: float) -> Column:
    """Grid row or column, at the edge for values outside; monotone in the value."""
    place = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(_CELLS)))
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0), F.least(F.lit(_CELLS - 1), place)).cast("long"))


def _cell_of(value: float, low: float, span: float) -> int:
    """The same for a number; the operations and their order are those of ``_cell``."""
    place = (value - low) / span * float(_CELLS)
    return 0 if place <= 0 else _CELLS - 1 if place >= _CELLS else math.floor(place)


def curve_key(lat: Column, lng: Column) -> Column:
    """Place on the curve; null without coordinates."""

    def spread(x: Column) -> Column:
        for shift, mask in _STEPS:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    row, col = _cell(lat.cast("double"), -90.0, 180.0), _cell(lng.cast("double"), -180.0, 360.0)
    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def box_ranges(low: tuple[float, float], high: tuple[float, float], pieces: int = PIECES) -> list[tuple[int, int]]:
    """At most ``pieces`` ranges (both ends included) of the curve that cover a box of (lat, lng).

    Quarters are cut, the largest first, while they lie only partly inside and room is left.
    """
    r0, c0 = _cell_of(low[0], -90.0, 180.0), _cell_of(low[1], -180.0, 360.0)
    r1, c1 = _cell_of(high[0], -90.0, 180.0), _cell_of(high[1], -180.0, 360.0)
    if r0 > r1 or c0 > c1:
        return []
    done: list[tuple[int, int]] = []
    open_ = [(-BITS, 0, 0, 0)]  # -size in bits, key of the first cell, its row and column
    while open_ and len(open_) + len(done) + 3 <= pieces:
        size, key, row, col = heapq.heappop(open_)
        width = 1 << -size
        if r0 <= row and row + width - 1 <= r1 and c0 <= col and col + width - 1 <= c1:
            done.append((key, key + width * width - 1))
            continue
        half = width >> 1
        for k in range(4):
            at = (row + half * (k >> 1), col + half * (k & 1))
            if at[0] <= r1 and at[0] + half - 1 >= r0 and at[1] <= c1 and at[1] + half - 1 >= c0:
                heapq.heappush(open_, (size + 1, key + k * half * half, *at))
    done += [(key, key + (1 << -2 * size) - 1) for size, key, _, _ in open_]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def write_layer(points: DataFrame, path: str, files: int | None = None, group_rows: int = GROUP_ROWS) -> None:
    """Write points (``lat``, ``lng``) with their curve key, clustered and sorted by it."""
    keyed = points.withColumn(CURVE, curve_key(F.col("lat"), F.col("lng")))
    ranged = keyed.repartitionByRange(files, CURVE) if files else keyed.repartitionByRange(CURVE)
    writer = ranged.sortWithinPartitions(CURVE).write.mode("overwrite").option("compression", "zstd")
    writer.option("parquet.block.row.count.limit", str(group_rows)).parquet(path)


def in_box(layer: DataFrame, low: tuple[float, float], high: tuple[float, float], pieces: int = PIECES) -> DataFrame:
    """Points of a stored layer with low <= (lat, lng) <= high."""
    ranges = box_ranges(low, high, pieces)
    near = F.lit(False)
    for a, b in ranges:
        near = near | F.col(CURVE).between(a, b)
    exact = F.col("lat").between(low[0], high[0]) & F.col("lng").between(low[1], high[1])
    return layer.filter(near & exact)
