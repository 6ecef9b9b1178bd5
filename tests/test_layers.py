"""Point layers along the curve: the key, the pieces of a box, what a box reads."""

import random

import pytest
from pyspark.sql import functions as F

from civicscope.plans.answers import Answers
from civicscope.plans.build import cluster_layers
from civicscope.sources import layers


def key_of(lat, lng):
    row, col = layers._cell_of(lat, -90.0, 180.0), layers._cell_of(lng, -180.0, 360.0)
    return sum(((row >> k & 1) << (2 * k + 1)) | ((col >> k & 1) << (2 * k)) for k in range(layers.BITS))


def points(n, seed):
    rng = random.Random(seed)
    some = [(k, rng.uniform(32.4, 32.9), rng.uniform(-117.4, -116.8), 2020 + k % 4) for k in range(n)]
    edge = [(-1, 90.0, 180.0, 2020), (-2, -95.0, 500.0, 2021), (-3, None, -117.0, 2021), (-4, float("nan"), -117.0, 2022), (-5, 32.5, -117.0, 2022), (-6, 32.6, -116.9, 2023)]
    return some + edge


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(points(40_000, 1), "point_id long, lat double, lng double, request_year int").cache()


def test_key_interleaves_rows_and_columns(spark, plain):
    rows = plain.limit(300).unionByName(plain.filter("point_id < 0")).withColumn("k", layers.curve_key(F.col("lat"), F.col("lng"))).collect()
    for r in rows:
        known = r.lat is not None and r.lat == r.lat
        assert r.k == (key_of(r.lat, r.lng) if known else None)


def test_pieces_cover_the_box_and_little_more():
    rng = random.Random(2)
    for _ in range(200):
        low = (rng.uniform(-80, 80), rng.uniform(-170, 170))
        high = tuple(x + rng.choice([0.0, 0.001, 0.1, 9.0]) for x in low)
        ranges = layers.box_ranges(low, high)
        assert 0 < len(ranges) <= layers.PIECES and all(a <= b for a, b in ranges)
        assert all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(20):
            k = key_of(rng.uniform(low[0], high[0]), rng.uniform(low[1], high[1]))
            assert any(a <= k <= b for a, b in ranges)
    wide = layers.box_ranges((32.5, -117.2), (32.6, -117.0))
    cells = (0.1 / 180) * (0.2 / 360) * 4**layers.BITS
    assert sum(b - a + 1 for a, b in wide) < 2.5 * cells
    assert layers.box_ranges((1.0, 1.0), (0.0, 2.0)) == []


def test_a_small_box_reads_few_rows(spark, plain, tmp_path):
    path = f"file://{tmp_path}/layer"
    layers.write_layer(plain, path, files=6, group_rows=500)
    stored = spark.read.parquet(path)
    for low, high in (((32.5, -117.0), (32.51, -116.99)), ((32.5, -117.0), (32.6, -116.9)), ((-90.0, -180.0), (90.0, 180.0))):
        found = layers.in_box(stored, low, high)
        want = plain.filter(F.col("lat").between(low[0], high[0]) & F.col("lng").between(low[1], high[1]))
        assert sorted(r.point_id for r in found.collect()) == sorted(r.point_id for r in want.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        if high[0] - low[0] < 1:
            assert read <= 2500 + 3 * want.count(), read
            assert "PushedFilters" in found._jdf.queryExecution().toString()


def test_questions_over_stored_layers(spark, plain, tmp_path):
    source = f"file://{tmp_path}/plain"
    plain.write.parquet(source)
    paths = cluster_layers(spark, {"map_311": source, "civic_energy": "elsewhere"}, f"file://{tmp_path}/stored")
    assert paths["civic_energy"] == "elsewhere" and paths["map_311"].endswith("stored/map_311")
    centres = spark.createDataFrame([("a", 32.6, -117.1), ("b", None, None)], "zip_code string, lat double, lng double")
    tables = [Answers({"map_311": spark.read.parquet(p), "zip_centroids": centres}) for p in (source, paths["map_311"])]
    for call in ({"zip_code": "a"}, {"zip_code": "b"}, {"zip_code": "none"}, {}, {"center_lat": 32.7, "center_lng": -117.0, "bbox_deg": 0.03, "year_min": 2021}, {"zip_code": "a", "sample": 20}):
        old, new = (a.map_points("311", **call) for a in tables)
        assert old.columns == new.columns and sorted(map(str, old.collect())) == sorted(map(str, new.collect()))
