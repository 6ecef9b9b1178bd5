"""Text readers, catalogue, health, sinks and incremental loading."""

import os
import shutil
from collections import Counter

from pyspark.sql import functions as F

from civicscope.operators.relations import shared_folder
from civicscope.sources import files
from civicscope.operators import counts
from civicscope.plans.tables import KEY, Tables
from civicscope.streaming.incremental import extend_cube, load_new_files
from standins import queries


def test_text_files_with_different_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ZIP,DBA NAME\n92101,One\n,Two\n")
    (tmp_path / "b.csv").write_text("DBA NAME,ZIP,NAICS\nThree,92102,7225\n")
    got = files.read_text_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert set(got.dtypes) == {("ZIP", "string"), ("DBA NAME", "string"), ("NAICS", "string")}
    assert sorted(map(str, (r["ZIP"] for r in got.collect()))) == ["92101", "92102", "None"]


def test_tab_file_and_key_range(spark, tmp_path):
    (tmp_path / "g.txt").write_text("GEOID\tNAME \n91900\tx\n92200\ty\nabc\tz\n92199\tw\n")
    got = files.read_text_table(spark, str(tmp_path / "g.txt"), sep="\t")
    kept = files.keep_key_range(got, "GEOID", 91900, 92199)
    assert sorted(r["GEOID"] for r in kept.collect()) == ["91900", "92199"]


def test_catalogue_skips_missing_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "here"))
    catalogue = {"here": str(tmp_path / "here"), "gone": str(tmp_path / "gone")}
    assert set(files.read_catalogue(spark, catalogue)) == {"here"}
    health = files.dataset_health(spark, catalogue)
    assert {r["dataset"]: r["available"] for r in health.collect()} == {"here": True, "gone": False}
    assert files.health_summary(health).first()["status"] == "ok"
    nothing = files.dataset_health(spark, {"gone": str(tmp_path / "gone")})
    assert tuple(files.health_summary(nothing).first()) == ("no_data", None)


def test_health_query_reads_the_tables(domain):
    rows = {r["dataset"]: r for r in queries.dataset_health(domain).collect()}
    assert len(rows) == len(queries.TABLE_NAMES) and all(r["data_as_of"] for r in rows.values())
    for name in ("orders", "documents"):
        assert rows[name]["files"] == 1 and rows[name]["row_count"] == domain.read(name).count()
    assert rows["orders"]["newest"] == domain.read("orders").agg(F.max("o_orderdate").cast("date")).first()[0]
    assert all(r["available"] == (r["row_count"] > 0) for r in rows.values())


def test_sorted_write_reports_rows(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    assert files.write_sorted(frame, str(tmp_path / "out"), ["k"], files=3) == 1000
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    assert any("zstd" in name for name in os.listdir(tmp_path / "out"))


def test_copy_only_when_newer(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    catalogue = {"x": (source, target), "y": (str(tmp_path / "none"), target)}
    assert files.refresh_copy(spark, catalogue) == {"x": "copied", "y": "missing"}
    assert files.refresh_copy(spark, catalogue)["x"] == "current"
    assert files.refresh_copy(spark, catalogue, force=True)["x"] == "copied"
    assert spark.read.parquet(target).count() == 3


def test_incremental_load_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    made = tmp_path / "made"
    spark.range(10).coalesce(1).write.parquet(str(made))
    part = next(p for p in os.listdir(made) if p.endswith(".parquet"))
    shutil.copy(made / part, source / "one.parquet")
    run = lambda: load_new_files(
        spark, str(source), str(tmp_path / "out"), str(tmp_path / "seen"), spark.range(1).schema)
    assert run().count() == 10
    assert run().count() == 10
    shutil.copy(made / part, source / "two.parquet")
    assert run().count() == 20


def test_incremental_load_of_one_file(spark, tmp_path):
    made = tmp_path / "made"
    spark.range(10).coalesce(1).write.parquet(str(made))
    part = next(p for p in os.listdir(made) if p.endswith(".parquet"))
    shutil.copy(made / part, tmp_path / "table.parquet")
    out = load_new_files(spark, str(tmp_path / "table.parquet"), str(tmp_path / "out"), str(tmp_path / "seen"), spark.range(1).schema)
    assert out.count() == 10


def test_incremental_load_of_a_directory_named_like_a_file(spark, tmp_path):
    spark.range(1500).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    out = load_new_files(spark, str(tmp_path / "orders.parquet"), str(tmp_path / "out"), str(tmp_path / "seen"), spark.range(1).schema)
    assert out.count() == 1500


BUSINESS = "account_id string, n int, zip_code string, category string, start_date date, status string"


def some_businesses(spark):
    """Nulls in every column, a place that holds a third of the rows, repeated rows, a clashing column ``n``."""
    return spark.range(300).selectExpr(
        "CAST(id AS string) AS account_id", "CAST(id AS int) AS n",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 <> 1 THEN CAST(id % 7 AS string) END AS zip_code",
        "CASE WHEN id % 5 <> 0 THEN CONCAT('c', id % 4) END AS category",
        "CASE WHEN id % 11 <> 0 THEN DATE_ADD(DATE '2014-06-01', CAST(id * 37 % 2000 AS int)) END AS start_date",
        "CASE WHEN id % 13 <> 0 THEN IF(id % 2 = 0, 'active', 'inactive') END AS status")


def tables_of(graph):
    names = ["business_cells", "business_by_zip", "business_summary", "trend_business_formation", "start_histogram"]
    return {name: sorted(map(str, graph[name].collect())) for name in names}


def test_a_cube_extended_by_the_other_half_equals_the_full_build(spark, tmp_path):
    rows = some_businesses(spark)
    source, root = str(tmp_path / "in"), str(tmp_path / "counted")
    for part in ("n < 150", "n >= 150"):
        rows.filter(part).repartition(2).write.mode("append").parquet(source)
        for _ in range(2):  # a second run finds nothing new
            cubes = extend_cube(spark, source, root, rows.schema, max_files=1)
    assert sorted(os.listdir(tmp_path / "counted" / "cube")) == [f"batch={i}" for i in range(4)]
    options = {"as_of": "2020-01-01", "previous_year": 2018, "current_year": 2019, "store": None}
    full = tables_of(Tables({"businesses": rows}.get, **options))
    assert tables_of(Tables({"business_cube": cubes}.get, **options)) == full
    direct = {"business_cells": counts.business_cells(rows, KEY), "trend_business_formation": counts.formation(rows, KEY),
              "start_histogram": counts.start_histogram(rows, [KEY, "category"])}
    for name, df in direct.items():
        assert sorted(map(str, df.collect())) == full[name]


def test_a_cube_of_no_files_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = some_businesses(spark)
    cubes = extend_cube(spark, str(tmp_path / "in"), str(tmp_path / "counted"), rows.schema)
    assert cubes.count() == 0 and counts.merged_cube(cubes, KEY).columns == [KEY, "category", "status", "start_date", "n"]


def test_cubes_are_merged_a_bounded_number_of_rows_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "CUBE_ROWS", 100)
    cube = counts.business_cube(some_businesses(spark).drop("n"), KEY)
    for _ in range(4):
        cube.write.mode("append").parquet(str(tmp_path / "cube"))
    cubes = spark.read.parquet(str(tmp_path / "cube"))
    merged = counts.merged_cube(cubes, KEY).withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r.task for r in merged).values()) <= 100  # some 300 groups
    want = Counter({tuple(r)[:4]: 4 * r.n for r in cube.collect()})
    assert Counter({tuple(r)[:4]: r.n for r in merged}) == want and len(merged) == len(want)


def test_the_businesses_are_scanned_once(spark, tmp_path):
    some_businesses(spark).write.parquet(str(tmp_path / "register"))
    readers = {}

    def store(name, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        readers[name] = plan.count("Relation [") if any("/businesses/" in f for f in df.inputFiles()) else 0
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    places = spark.createDataFrame([("hot", "H", "A")], "zip_code string, neighborhood string, area string")
    sources = {"businesses": spark.read.parquet(str(tmp_path / "register")), "names": places.drop("area"), "areas": places.drop("neighborhood")}
    graph = Tables(sources.get, "2020-01-01", 2018, 2019, store=store, one_scan=True)
    for name in ["business_by_zip", "business_summary", "trend_business_formation", "business_age_stats", "business_age_by_area", "yearly_series"]:
        assert graph.get(name) is not None
    assert {name: n for name, n in readers.items() if n} == {"business_cube": 1}


def test_lookup_table(spark):
    got = files.lookup_table(spark, {"a": "x", "b": "y"}, "k", "v")
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("b", "y")]


def test_shared_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (folder.rstrip("/") if folder else shared_folder(spark)) or folder is None
