"""Points, boxes, density cells and neighbours on latitude / longitude columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.operators.relations import collect_top, hot_keys, settled, skew_join, top_n

# Metres per degree used by the local projection.
METRES_PER_DEGREE = 111320.0

# Half-width of the box around one place, padding around a group of
# places, box of a group without any centre, reach of "nearby".
PLACE_BOX_DEG = 0.05
GROUP_PADDING_DEG = 0.02
DEFAULT_BOX_DEG = 0.08
NEARBY_DEG = 0.1


def within_box(
    points: DataFrame, lat: float, lng: float, half: float, lat_col: str = "lat", lng_col: str = "lng"
) -> DataFrame:
    """Points inside a box; plain range predicates, so Parquet statistics apply."""
    return points.filter(
        F.col(lat_col).between(lat - half, lat + half)
        & F.col(lng_col).between(lng - half, lng + half)
    )


def centre_of(centroids: DataFrame, key: str, value: str) -> tuple[float | None, float | None]:
    """Latitude and longitude of one key's centre, looked up now; None where it has none."""
    row = centroids.filter(F.col(key) == value).agg(F.max("lat"), F.max("lng")).first()
    return (row[0], row[1])


def within_box_of(
    points: DataFrame,
    centroids: DataFrame,
    key: str,
    value: str,
    half: float = PLACE_BOX_DEG,
    lat_col: str = "lat",
    lng_col: str = "lng",
) -> DataFrame:
    """Points in the box around one key's centre; all points when it has no centre."""
    centre = centroids.filter(F.col(key) == value).agg(F.max("lat").alias("lat"), F.max("lng").alias("lng"))

    def edge(name: str, step: float, open_end: float) -> Column:
        return centre.select(F.coalesce(F.col(name) + F.lit(step), F.lit(open_end))).scalar()

    return points.filter(
        (F.col(lat_col) >= edge("lat", -half, -math.inf))
        & (F.col(lat_col) <= edge("lat", half, math.inf))
        & (F.col(lng_col) >= edge("lng", -half, -math.inf))
        & (F.col(lng_col) <= edge("lng", half, math.inf))
    )


def view_boxes(
    mapping: DataFrame,
    centroids: DataFrame,
    key: str,
    group: str,
    default_centre: tuple[float, float],
    padding: float = GROUP_PADDING_DEG,
    default_half: float = DEFAULT_BOX_DEG,
) -> DataFrame:
    """Centre and half-width of the box covering each group's places."""
    joined = mapping.select(key, group).join(centroids, key, "left")
    span = F.greatest(F.max("lat") - F.min("lat"), F.max("lng") - F.min("lng"))
    return joined.groupBy(group).agg(
        F.coalesce(F.avg("lat"), F.lit(default_centre[0])).alias("center_lat"),
        F.coalesce(F.avg("lng"), F.lit(default_centre[1])).alias("center_lng"),
        F.coalesce(span / 2 + F.lit(padding), F.lit(default_half)).alias("half_deg"),
    )


def grid_density(points: DataFrame, cell_deg: float, by: Sequence[str] = ()) -> DataFrame:
    """Points per square cell of ``cell_deg`` degrees."""
    row = F.floor(F.col("lat") / F.lit(cell_deg)).alias("cell_row")
    col = F.floor(F.col("lng") / F.lit(cell_deg)).alias("cell_col")
    return points.groupBy(*by, row, col).agg(F.count(F.lit(1)).alias("points"))


def hex_density(
    points: DataFrame, origin: tuple[float, float], radius_m: float = 100.0, by: Sequence[str] = ()
) -> DataFrame:
    """Points per hexagon (pointy top, radius in metres) in axial coordinates.

    Degrees become metres on a plane touching the origin; the nearest hexagon is
    found by rounding cube coordinates and repairing the worst one.
    """
    lat0, lng0 = origin
    x = (F.col("lng") - F.lit(lng0)) * F.lit(METRES_PER_DEGREE * math.cos(math.radians(lat0)))
    y = (F.col("lat") - F.lit(lat0)) * F.lit(METRES_PER_DEGREE)
    placed = points.withColumn("_q", x * F.lit(math.sqrt(3) / 3 / radius_m) - y * F.lit(1 / 3 / radius_m))
    placed = placed.withColumn("_r", y * F.lit(2 / 3 / radius_m))
    placed = placed.withColumn("_s", -F.col("_q") - F.col("_r"))
    for axis in "qrs":
        placed = placed.withColumn(f"_{axis}0", F.floor(F.col(f"_{axis}") + F.lit(0.5)))
        placed = placed.withColumn(f"_d{axis}", F.abs(F.col(f"_{axis}0") - F.col(f"_{axis}")))
    q_worst = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    r_worst = ~q_worst & (F.col("_dr") > F.col("_ds"))
    hex_q = F.when(q_worst, -F.col("_r0") - F.col("_s0")).otherwise(F.col("_q0")).alias("hex_q")
    hex_r = F.when(r_worst, -F.col("_q0") - F.col("_s0")).otherwise(F.col("_r0")).alias("hex_r")
    return placed.groupBy(*by, hex_q, hex_r).agg(F.count(F.lit(1)).alias("points"))


# ---------------------------------------------------------------- neighbours


def near_centre(lat: Column, lng: Column, lat0: Column, lng0: Column, reach: float) -> Column:
    """Exact nearness test: both coordinate differences within reach."""
    return (F.abs(lat - lat0) <= F.lit(reach)) & (F.abs(lng - lng0) <= F.lit(reach))


def nearby(
    places: DataFrame, centroids: DataFrame, key: str, value: str, reach: float = NEARBY_DEG,
    include_self: bool = True,
) -> DataFrame:
    """Places near one centre; none when the centre has no coordinates."""
    centre = centroids.filter(F.col(key) == value).agg(F.max("lat").alias("lat"), F.max("lng").alias("lng"))
    lat0, lng0 = centre.select("lat").scalar(), centre.select("lng").scalar()
    located = places.join(centroids.select(key, "lat", "lng"), key)
    found = located.filter(near_centre(F.col("lat"), F.col("lng"), lat0, lng0, reach))
    return found if include_self else found.filter(F.col(key) != value)


def _cells(df: DataFrame, level: int, depth: int, row: str = "cell_row", col: str = "cell_col") -> DataFrame:
    """The cells of a level, from the finest ones; cells of the next level are their quarters."""
    fine = {row: "fine_row", col: "fine_col"}
    return df.withColumns({name: F.shiftright(f, depth - level) for name, f in fine.items()})


def _beats(score: str, key: str) -> Column:
    """A place that comes before the mark, the n-th certain neighbour, if there is one."""
    mark, mark_key = F.col("_mark"), F.col("_mark_key")
    before = (F.col(score) > mark) | (mark.isNull() & F.col(score).isNotNull())
    return mark_key.isNull() | before | (F.col(score).eqNullSafe(mark) & (F.col(key) < mark_key))


def neighbour_candidates(
    places: DataFrame,
    key: str,
    score: str,
    by: Sequence[str] = (),
    reach: float = NEARBY_DEG,
    n: int = 20,
    salts: int = 32,
    tested: int = 512,
    depth: int = 12,
) -> DataFrame:
    """(by, key, lat, lng, near_*) rows among which are every place's n best neighbours.

    Space is cut into cells of reach/3, halved from level to level.  A pair of a centre cell and a
    place cell is *inside* (all of one are near all of the other), *outside*, or crossed by the
    edge of somebody's reach.  Inside pairs offer the n best of the place cell; the n best offers
    are *certain* neighbours of all centres of the cell, the last of them its mark.  Crossed pairs
    whose best place does not beat the mark are done.  Of the others, pairs of at most ``tested``
    (centre, place) combinations are tested place by place, larger ones descend: quarters of both
    cells form the pairs of the next level, and the centres' quarters inherit what is certain.

    So a crowded cell offers n rows wherever it lies wholly within reach, and what remains crossed
    gets thinner by half each time.  At ``depth`` (cells of reach/3/2**depth) all is tested.
    Places at one spot are represented by its n best.  ``by`` rows and keys as in `nearby_top`.
    """
    by = list(by)
    fine = F.lit(3 * (1 << depth) / reach)
    located = settled(
        places.select(
            *by,
            key,
            "lat",
            "lng",
            F.col(score).alias("score"),
            F.floor(F.col("lat") * fine).alias("fine_row"),
            F.floor(F.col("lng") * fine).alias("fine_col"),
        )
    )
    best = [F.col("score").desc_nulls_last(), F.col(key).asc()]
    eligible = top_n(located, [*by, "lat", "lng"], best, n)
    cell, near = [*by, "cell_row", "cell_col"], [*by, "near_row", "near_col"]
    near_names = {"cell_row": "near_row", "cell_col": "near_col"}
    parent = {"cell_row": "up_row", "cell_col": "up_col"}
    up = [*by, "up_row", "up_col"]
    found, crossed, certain = [], None, None

    for level in range(depth + 1):
        edge = 3 << level  # cells that the reach spans
        centres, spots = _cells(located, level, depth), _cells(eligible, level, depth)
        if level:
            centres = _cells(centres, level - 1, depth, "up_row", "up_col")
            spots = _cells(spots, level - 1, depth, "up_row", "up_col")
            centres = centres.join(crossed.select(*cell).withColumnsRenamed(parent).distinct(), up, "left_semi")
            above = crossed.select(*near).withColumnsRenamed({v: parent[k] for k, v in near_names.items()})
            spots = spots.join(above.distinct(), up, "left_semi")
        family = [*cell, *(["up_row", "up_col"] if level else [])]
        own = settled(centres.groupBy(*family).agg(F.count(F.lit(1)).alias("_centres")))
        champions = top_n(spots, cell, best, n, "_position")
        counts = spots.groupBy(*family).agg(F.count(F.lit(1)).alias("_spots"))
        first = champions.filter("_position = 1").select(*cell, F.col("score").alias("_best"), F.col(key).alias("_best_key"))
        around = counts.join(first, cell).withColumnsRenamed(near_names)
        if level:
            around = around.withColumnsRenamed({"up_row": "near_up_row", "up_col": "near_up_col"})
            open_ = crossed.select(*cell, *near[len(by) :])
            open_ = open_.withColumnsRenamed(parent | {"near_row": "near_up_row", "near_col": "near_up_col"})
            pairs = open_.join(own, up).join(around, [*by, "near_up_row", "near_up_col"])
        else:
            span = [F.lit(k) for k in range(-edge - 1, edge + 2)]
            listed = own.withColumn("_r", F.explode(F.array(*span))).withColumn("_c", F.explode(F.array(*span)))
            listed = listed.withColumns({"near_row": F.col("cell_row") + F.col("_r"), "near_col": F.col("cell_col") + F.col("_c")})
            pairs = listed.join(around, near)
        apart = F.greatest(*[F.abs(F.col(f"near_{x}") - F.col(f"cell_{x}")) for x in ("row", "col")])
        pairs = pairs.withColumn("_apart", apart).filter(F.col("_apart") <= edge + 1)
        pairs = settled(pairs.select(*cell, *near[len(by) :], "_centres", "_spots", "_best", "_best_key", "_apart"))

        # A whole cell of margin on either side: rounding never decides.
        inside = pairs.filter(F.col("_apart") <= edge - 2).select(*cell, *near[len(by) :])
        offers = inside.join(champions.drop("_position", "fine_row", "fine_col", "up_row", "up_col").withColumnsRenamed(near_names), near)
        offers = offers.select(*cell, key, "lat", "lng", "score")
        if level:
            offers = offers.unionByName(certain.withColumnsRenamed(parent).join(own.select(*family), up).select(*cell, key, "lat", "lng", "score"))
        certain = settled(top_n(offers, cell, best, n, "_position"))
        nth = certain.filter(F.col("_position") == n).select(*cell, F.col("score").alias("_mark"), F.col(key).alias("_mark_key"))
        certain = certain.drop("_position")
        edges = pairs.filter(F.col("_apart") > edge - 2).join(nth, cell, "left")
        edges = settled(edges.filter(_beats("_best", "_best_key")))
        small = F.lit(level == depth) | (F.col("_centres") * F.col("_spots") <= tested)
        crossed = edges.filter(~small)
        on = crossed.limit(1).count() > 0

        hot = hot_keys(spots, cell)
        moved = spots.select(*cell, key, "lat", "lng", "score").withColumnsRenamed(near_names)
        probes = edges.filter(small).select(*cell, *near[len(by) :], "_mark", "_mark_key")
        rest = skew_join(moved, probes, near, [key], hot.withColumnsRenamed(near_names), salts).filter(_beats("score", key))
        # No centre of the cell is nearer than the cell's edge (a hair is left for rounding).
        size = reach / edge
        for value, index in (("lat", "cell_row"), ("lng", "cell_col")):
            low = F.col(index) * F.lit(size) - F.lit(reach + 1e-9 + size / 1000)
            high = (F.col(index) + 1) * F.lit(size) + F.lit(reach + 1e-9 + size / 1000)
            rest = rest.filter(F.col(value).between(low, high))
        final = certain.join(crossed.select(*cell).distinct(), cell, "left_anti") if on else certain
        rows = final.unionByName(rest.select(*cell, key, "lat", "lng", "score"))
        rows = rows.withColumnsRenamed({key: "near_key", "lat": "near_lat", "lng": "near_lng", "score": "near_score"})
        mine = _cells(located, level, depth).select(*cell, key, "lat", "lng")
        crowd = own.filter(F.col("_centres") * 1000 > own.agg(F.sum("_centres")).scalar()).select(*cell)
        found.append(skew_join(mine, settled(rows), cell, [key], crowd, salts).drop("cell_row", "cell_col"))
        if not on:
            break
    return reduce(DataFrame.unionByName, found)


def nearby_top(
    places: DataFrame,
    key: str,
    score: str,
    by: Sequence[str] = (),
    reach: float = NEARBY_DEG,
    n: int = 20,
    salts: int = 32,
    tested: int = 512,
) -> DataFrame:
    """For every place, its n best neighbours by score (self included), exactly.

    ``places`` has the key, ``lat``, ``lng``, the score and ``by`` columns, one row
    per key and ``by`` value.  Ties go by key; ``tested`` as in `neighbour_candidates`.
    """
    by = list(by)
    pairs = neighbour_candidates(places, key, score, by, reach, n, salts, tested).filter(
        near_centre(F.col("near_lat"), F.col("near_lng"), F.col("lat"), F.col("lng"), reach)
    )
    order = [F.col("near_score").desc_nulls_last(), F.col("near_key").asc()]
    return top_n(pairs, [*by, key], order, n, "position").select(
        *by, key, "position", "near_key", F.col("near_score").alias(score)
    )


def nearby_lists(
    places: DataFrame, key: str, score: str, by: Sequence[str] = (), reach: float = NEARBY_DEG, n: int = 20
) -> DataFrame:
    """``nearby_top`` with the neighbours of each place packed into one array."""
    rows = nearby_top(places, key, score, by, reach, n)
    return collect_top(rows, [*by, key], [F.col("position")], n, ["near_key", score], "nearby")
