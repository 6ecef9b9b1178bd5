"""Operators against brute force and hand-computed frames."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from civicscope.operators import compare, counts, geo, narrative, ranks, relations, trends
from civicscope.plans.tables import as_date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# ---------------------------------------------------------------- relations


def test_missing_keys_are_not_unmapped(spark):
    mapping = spark.createDataFrame([("a", "X"), (None, "Y")], "k string, area string")
    universe = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    full = relations.complete_mapping(mapping.filter("k is not null"), universe, "k", "area")
    assert rows(full, "k", "area") == [("a", "X"), ("b", "Other")]
    left = relations.lacking_key_in(universe, mapping, "k")
    assert rows(left, "k") == [("b",), ("b",)]


def test_latest_overall_and_per_key(spark):
    data = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 3, 1)], "k string, y int, n int")
    assert rows(relations.latest(data, "y"), "k", "y") == [("b", 3)]
    assert rows(relations.latest(data, "y", ["k"]), "k", "y") == [("a", 2), ("b", 3)]
    assert rows(relations.latest(data, "y", ["k"], F.col("n") > 0), "k", "y") == [("a", 1), ("b", 3)]


def test_skew_join_equals_plain_join(spark):
    big = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).cast("bigint").alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k bigint, v string")
    hot = relations.hot_keys(big, ["k"], share=3)
    assert rows(hot, "k") == [(0,)]
    for how in ("inner", "left"):
        joined = relations.skew_join(big, small, ["k"], ["id"], hot, salts=8, how=how)
        assert sorted(map(str, joined.select("id", "v").collect())) == sorted(
            map(str, big.join(small, "k", how).select("id", "v").collect()))
    assert relations.hot_keys(big, ["k"], share=1).count() == 0


def test_numbering_and_samples_cover_all_rows(spark):
    data = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(7)
    order = [F.col("v").desc(), F.col("id")]
    want = [r["id"] for r in data.orderBy(*order).collect()]
    for n in (None, 6000):
        got = sorted(relations.ordered_head(data, order, n, "p").collect(), key=lambda r: r["p"])
        assert [r["id"] for r in got] == want and [r["p"] for r in got] == list(range(1, 1001))
    assert [r["id"] for r in relations.ordered_head(data, order, 5, "p").orderBy("p").collect()] == want[:5]
    scattered = F.col("id") * 40503 % 1024
    for n, shift in ((1, 6), (130, 6), (999, 3), (5000, 6)):
        kept = relations.smallest(data, scattered, ["id"], n, shift)
        assert kept.columns == ["id", "v"]
        assert {r["id"] for r in kept.collect()} == set(sorted(range(1000), key=lambda i: (i * 40503 % 1024, i))[:n])


def test_metric_names_are_checked():
    with pytest.raises(ValueError):
        relations.require_metric("1; drop", ["population"])


def test_column_resolution(spark):
    df = spark.createDataFrame([("1",)], "Zip string")
    assert relations.find_column(df, "ZIP", "zip_code") == "Zip"
    got = df.select(relations.column_or(df, ["nope"], "unknown", "string").alias("c")).first()
    assert got["c"] == "unknown"


# ---------------------------------------------------------------- ranks


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_rank_equals_sorting(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, 0.0, rng.uniform(-5, 5), float(rng.randrange(4)), None]) for _ in range(600)]
    frame = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)], "id int, metric string, value double")
    known = [v for v in values if v is not None]
    for down in (True, False):
        got = {r["id"]: (r["rank"], r["of"]) for r in ranks.rank_long(frame, ["id"], down).collect()}
        for i, v in enumerate(values):
            if v is None:
                assert i not in got
            else:
                better = sum(1 for k in known if (k > v if down else k < v))
                assert got[i] == (better + 1, len(known))


def test_crowded_rank_buckets_are_cut_until_small(spark):
    """One extremely dense range, a few far values and a hot one: no bucket over the bound, ranks exact."""
    rng = random.Random(3)
    dense = [1.0 + rng.randrange(1 << 20) * 2.0**-50 for _ in range(6000)]
    values = {"a": dense + [-1e300, 5.0, 1e300] + [7.5] * 2000, "b": [float(i % 7) for i in range(50)], "c": [1.0]}
    data = [(i, m, v) for m, listed in values.items() for i, v in enumerate(listed)]
    frame = spark.createDataFrame(data, "id int, metric string, value double")
    for most, fan_out in ((100, 16), (700, 128), (10_000, 128)):
        distinct = frame.groupBy("metric", "value").count()
        placed = ranks.rank_buckets(distinct, "metric", "value", most, fan_out)
        found = sorted((r["metric"], r["value"], r["_bucket"]) for r in placed.collect())
        assert [(m, v) for m, v, _ in found] == sorted({(m, v) for _, m, v in data})
        assert all(x[2] <= y[2] for x, y in zip(found, found[1:]) if x[0] == y[0])
        sizes = {}
        for m, _, bucket in found:
            sizes[m, bucket] = sizes.get((m, bucket), 0) + 1
        assert max(sizes.values()) <= most
        assert sum(1 for m, _ in sizes if m == "c") == 1
        got = {(r["metric"], r["value"]): (r["below"], r["ties"], r["known"]) for r in
               ranks.value_positions(frame, most=most, fan_out=fan_out).collect()}
        for m, listed in values.items():
            ordered = sorted(listed)
            for v in set(listed):
                low = bisect.bisect_left(ordered, v)
                assert got[m, v] == (low, bisect.bisect_right(ordered, v) - low, len(listed))
    with pytest.raises(ValueError):
        ranks.rank_buckets(frame, "metric", "value", 10, 100)


def test_percentile_formula_and_single_row(spark):
    frame = spark.createDataFrame([(i, "population", float(i)) for i in range(5)], "id int, metric string, value double")
    got = {r["id"]: r["percentile"] for r in ranks.percentiles(frame, ["id"]).collect()}
    assert got == {4: 100, 3: 75, 2: 50, 1: 25, 0: 0}
    alone = ranks.percentiles(frame.limit(1), ["id"]).first()
    assert (alone["rank"], alone["of"], alone["percentile"]) == (1, 1, 0)


def test_percent_rank_null_policies(spark):
    frame = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, None)], "id int, m double")
    last = {r["id"]: r["p"] for r in ranks.percent_ranks(frame, ["id"], {"m": "p"}).collect()}
    assert last == {1: 0.0, 2: pytest.approx(1 / 3), 3: pytest.approx(2 / 3), 4: pytest.approx(2 / 3)}
    neutral = {r["id"]: r["p"] for r in ranks.percent_ranks(frame, ["id"], {"m": "p"}, "neutral").collect()}
    assert neutral == {1: 0.0, 2: 1.0, 3: None, 4: None}


def test_all_missing_metric(spark):
    frame = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id int, m double, n double")
    got = ranks.percent_ranks(frame, ["id"], {"m": "pm", "n": "pn"}).orderBy("id").collect()
    assert [(r["pm"], r["pn"]) for r in got] == [(0.0, 0.0), (1.0, 0.0)]


def test_ranking_breaks_ties_by_key(spark):
    frame = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", None)], "k string, population int")
    got = ranks.ranking(frame, "population", "k", 3).orderBy("rank").collect()
    assert [(r["rank"], r["k"]) for r in got] == [(1, "c"), (2, "a"), (3, "b")]


# ---------------------------------------------------------------- trends and momentum


def test_yoy_uses_previous_row(spark):
    data = spark.createDataFrame(
        [("s", 2000, 10), ("s", 2002, 15), ("s", 2003, 0), ("s", 2004, 5)], "series string, year int, count bigint"
    )
    got = [r["yoy_pct"] for r in trends.with_yoy(data, []).orderBy("year").collect()]
    assert got == [None, 50.0, -100.0, None]
    dense = [r["yoy_pct"] for r in trends.with_yoy(data, [], dense_years=True).orderBy("year").collect()]
    assert dense == [None, None, -100.0, None]


def momentum_input(spark):
    entries = []
    for key, before, now in [("a", 10, 20), ("b", 10, 15), ("c", 10, 5)]:
        entries += [(key, "business_formation", 1999, before), (key, "business_formation", 2000, now)]
    entries += [("a", "crime", 1999, 10), ("a", "crime", 2000, 5), ("b", "crime", 1999, 10), ("b", "crime", 2000, 10)]
    entries += [("z", "solar", 1999, 1), ("z", "solar", 2000, 2), ("a", "permits", 1999, 0), ("a", "permits", 2000, 4)]
    return spark.createDataFrame(entries, "k string, series string, year int, count bigint")


def test_momentum_null_policies(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: r for r in trends.momentum(momentum_input(spark), universe, "k", 1999, 2000).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["biz_formation_yoy"], got["a"]["crime_yoy"], got["a"]["permit_yoy"]) == (100.0, 50.0, None)
    # Missing crime change of c ranks above both known ones; all-missing series rank 0.
    assert got["c"]["momentum_score"] == 25.0
    assert got["a"]["momentum_score"] == 37.5
    neutral = {
        r["k"]: r["momentum_score"]
        for r in trends.momentum(momentum_input(spark), universe, "k", 1999, 2000, "neutral").collect()
    }
    assert neutral == {"a": 25 + 12.5 + 25 + 12.5, "b": 12.5 + 12.5 + 0 + 12.5, "c": 0 + 12.5 + 12.5 + 12.5}


def test_city_series_is_per_place(spark):
    data = spark.createDataFrame(
        [("a", "s", 2000, 4), ("a", "s", 2000, 2), ("b", "s", 2000, 1)], "k string, series string, year int, count bigint"
    )
    assert rows(trends.series_per_place(data, "k"), "year", "count") == [(2000, 3.5)]


# ---------------------------------------------------------------- counts


def test_age_statistics(spark):
    data = spark.createDataFrame(
        [("x", "2000-01-01", "active")] * 2 + [("x", "1990-01-01", "active"), ("x", "1995-01-01", "inactive"),
         ("y", "2000-01-01", "active")],
        "category string, start string, status string",
    ).withColumn("start_date", F.col("start").cast("date"))
    got = counts.age_statistics(counts.start_histogram(data, ["category"]), ["category"], as_date("2001-01-01")).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["business_count"], row["median_age_years"], row["avg_age_years"]) == (3, 1.0, 4.3)
    assert (row["pct_under_2yr"], row["pct_over_10yr"]) == (66.7, 33.3)


def test_city_averages_with_absent_tables(spark):
    summary = spark.createDataFrame([("a", 3, 2, 1)], "zip_code string, total_count bigint, active_count bigint, category_count bigint")
    row = counts.city_averages(None, summary, None, "zip_code").first()
    assert row["avg_active_businesses"] == 2.0 and row["avg_population"] is None and row["avg_crime_count"] is None
    assert counts.city_averages(None, None, None, "zip_code") is None


# ---------------------------------------------------------------- geo


def random_places(spark, seed, n, spread):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        hot = rng.random() < 0.3
        lat = 32.5 if hot else 32.5 + rng.choice([rng.uniform(0, spread), rng.randrange(20) * 0.05])
        lng = -117.0 if hot else -117.0 + rng.choice([rng.uniform(0, spread), rng.randrange(20) * 0.05])
        data.append((rng.choice("ab"), f"p{i:04d}", lat, lng, rng.randrange(6)))
    return data, spark.createDataFrame(data, "c string, k string, lat double, lng double, n int")


@pytest.mark.parametrize("seed,n,spread,keep", [(1, 400, 0.8, 5), (2, 150, 0.3, 20), (3, 60, 3.0, 3)])
def test_nearby_top_equals_brute_force(spark, monkeypatch, seed, n, spread, keep):
    data, frame = random_places(spark, seed, n, spread)
    want = set()
    for c, k, lat, lng, _ in data:
        near = [(-m, q) for d, q, y, x, m in data if d == c and abs(y - lat) <= 0.1 and abs(x - lng) <= 0.1]
        want |= {(c, k, i + 1, q, -m) for i, (m, q) in enumerate(sorted(near)[:keep])}
    monkeypatch.setattr(geo, "hot_keys", lambda df, on: relations.hot_keys(df, on, share=20))
    got = geo.nearby_top(frame, "k", "n", ["c"], 0.1, keep, salts=4)
    assert {tuple(r) for r in got.select("c", "k", "position", "near_key", "n").collect()} == want


@pytest.mark.parametrize("seed,n,spread,tested", [(11, 150, 0.3, 6), (12, 120, 0.05, 30), (13, 200, 0.5, 200)])
def test_nearby_top_in_halved_cells(spark, seed, n, spread, tested):
    """Few pairs are tested at once, so most descend; some places share a spot, some have no score or place."""
    data, frame = random_places(spark, seed, n, spread)
    rows = [(c, k, data[i // 7 * 7][2], data[i // 7 * 7][3], None if i % 11 == 0 else float(m % 5)) if i % 3 else (c, k, y, x, float(m)) for i, (c, k, y, x, m) in enumerate(data)]
    rows.append((rows[0][0], "lost", None, None, 9.0))
    want = set()
    for c, k, y, x, _ in rows[:-1]:
        near = [(m is None, -(m or 0), q, m) for d, q, b, a, m in rows[:-1] if d == c and abs(b - y) <= 0.1 and abs(a - x) <= 0.1]
        want |= {(c, k, i + 1, q, m) for i, (_, _, q, m) in enumerate(sorted(near, key=lambda r: r[:3])[:4])}
    places = spark.createDataFrame(rows, "c string, k string, lat double, lng double, n double")
    got = geo.nearby_top(places, "k", "n", ["c"], 0.1, 4, salts=4, tested=tested)
    assert {tuple(r) for r in got.select("c", "k", "position", "near_key", "n").collect()} == want


def test_neighbour_candidates_grow_linearly(spark):
    """n weak places beside n strong ones, some of them out of reach: the product would grow fourfold."""
    rng, made = random.Random(5), []
    for n in (500, 1000, 2000):
        weak = [(f"w{k}", rng.uniform(0.001, 0.033), rng.uniform(0.001, 0.033), rng.random()) for k in range(n)]
        strong = [(f"s{k}", rng.uniform(0.001, 0.033), rng.uniform(0.101, 0.133), 10 + rng.random()) for k in range(n)]
        places = spark.createDataFrame(weak + strong, "k string, lat double, lng double, n double")
        made.append(geo.neighbour_candidates(places, "k", "n", reach=0.1, n=5).count())
    assert made[2] < 6 * made[0] and all(rows < 64 * n for rows, n in zip(made, (500, 1000, 2000)))


def test_nearby_without_centre_is_empty(spark):
    data, frame = random_places(spark, 4, 30, 0.3)
    centres = frame.select("k", "lat", "lng")
    plain = frame.drop("lat", "lng")
    assert geo.nearby(plain, centres, "k", "nowhere").count() == 0
    assert geo.nearby(plain, centres, "k", "p0000").filter("k = 'p0000'").count() == 1
    assert geo.nearby(plain, centres, "k", "p0000", include_self=False).filter("k = 'p0000'").count() == 0


def test_box_without_centre_keeps_all(spark):
    _, frame = random_places(spark, 5, 30, 0.3)
    centres = frame.select("k", "lat", "lng")
    assert geo.within_box_of(frame, centres, "k", "nowhere").count() == 30
    assert 0 < geo.within_box_of(frame, centres, "k", "p0001").count() <= 30


def test_hexagons_hold_near_points(spark):
    """Every point lies within one radius of its hexagon's centre."""
    import math

    _, frame = random_places(spark, 6, 300, 0.05)
    assert geo.hex_density(frame, (32.5, -117.0)).agg(F.sum("points")).first()[0] == 300
    cells = geo.hex_density(frame.withColumn("id", F.col("k")), (32.5, -117.0), 100.0, ["id", "lat", "lng"]).collect()
    for r in cells:
        x = (r["lng"] + 117.0) * geo.METRES_PER_DEGREE * math.cos(math.radians(32.5))
        y = (r["lat"] - 32.5) * geo.METRES_PER_DEGREE
        cx = 100 * math.sqrt(3) * (r["hex_q"] + r["hex_r"] / 2)
        cy = 100 * 1.5 * r["hex_r"]
        assert math.hypot(x - cx, y - cy) <= 100.001


# ---------------------------------------------------------------- comparisons and sentences


def test_winner(spark):
    data = spark.createDataFrame(
        [(2.0, 1.0, "good"), (2.0, 1.0, "bad"), (2.0, 1.0, "neutral"), (1.0, 1.0, "good"), (None, 1.0, "good")],
        "a double, b double, s string",
    )
    got = [r[0] for r in data.select(compare.winner(F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert got == ["a", "b", "", "", ""]


def test_merge_counts_missing_as_zero(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "category string, active_count bigint")
    b = spark.createDataFrame([("y", 5)], "category string, active_count bigint")
    got = [tuple(r) for r in compare.merged_categories(a, b).collect()]
    assert got == [("y", 1, 5), ("x", 3, 0)]


def sentence(spark, value, average, momentum=None, category=None, age=None):
    metrics = [("m1", "a1", "income", "good", "lower"), ("m2", "a2", "crime", "bad", "less")]
    one = spark.createDataFrame(
        [(*value, *average, momentum, category, age)],
        "m1 double, m2 double, a1 double, a2 double, s double, c string, g double",
    )
    built = narrative.place_sentence(F.col, F.col, F.col("s"), F.col("c"), F.col("g"), metrics, peer="place")
    return one.select(built).first()[0]


def test_place_sentence_bands(spark):
    start = "compared to the avg place: "
    assert sentence(spark, (1.0, 1.0), (1.0, 1.0)) == "close to city average across most metrics"
    assert sentence(spark, (25.0, 1.0), (10.0, 1.0)) == start + "2x the income"
    assert sentence(spark, (110.0, 40.0), (10.0, 10.0)) == start + "far more income — but 4x the crime"
    assert sentence(spark, (13.0, 1.0), (10.0, 10.0), 62.0) == (
        start + "1/10 the crime, 30% more income. momentum score: 62/100 (strong growth trajectory)")
    assert sentence(spark, (6.0, None), (10.0, 10.0), 40.5, "bar", 3.0) == (
        start + "40% lower income. momentum score: 40.5/100 (moderate growth)"
        ". most common business type (bar) has median age of 3.0 years")
    assert sentence(spark, (0.5, 20.0), (10.0, 0.0)) == start + "far lower income"


def test_pair_sentence(spark):
    one = spark.createDataFrame([("A", "B", 30.0, 10.0, 5.0, 0.0)], "x string, y string, a1 double, b1 double, a2 double, b2 double")
    metrics = [("1", "", "income", "good", "lower"), ("2", "", "crime", "bad", "less")]
    built = narrative.place_pair_sentence(
        F.col("x"), F.col("y"), lambda m: F.col("a" + m), lambda m: F.col("b" + m), metrics
    )
    assert one.select(built).first()[0] == "A has 3x more income — B has far less crime"


def test_area_pair_sentence(spark):
    one = spark.createDataFrame([("East", "West", 30.0, 10.0, 5.0, 5.2)], "x string, y string, a1 double, b1 double, a2 double, b2 double")
    metrics = [("1", "businesses", "good"), ("2", "crime", "bad")]
    built = narrative.area_pair_sentence(
        F.col("x"), F.col("y"), lambda m: F.col("a" + m), lambda m: F.col("b" + m), metrics
    )
    assert one.select(built).first()[0] == "east has 200% more businesses."
