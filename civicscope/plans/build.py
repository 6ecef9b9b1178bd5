"""Build every table from raw files, and open the built tables for questions.

    spark-submit civicscope/plans/build.py --config build.json --target hdfs://.../tables

The config names the inputs: ``register`` (CSV paths), ``census``, ``gazetteer``,
``names`` / ``areas`` / ``plans`` (CSV look-ups of the place key), ``as_of``,
``previous_year``, ``current_year`` and ``tables`` (civic table name -> Parquet path);
``buckets`` is optional.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from civicscope.plans.answers import LAYERS, Answers
from civicscope.plans.contracts import check_contract
from civicscope.plans.tables import KEY, PEERS, SOURCES, Tables, businesses, demographics
from civicscope.sources import files, layers

# Columns each table is clustered by, so that a filter on them skips files.
CLUSTERED = {
    "businesses": [KEY, "category", "account_id"],
    "business_cube": [KEY, "category"],
    "business_cells": [KEY],
    "business_by_zip": [KEY],
    "business_summary": [KEY],
    "demographics": [KEY],
    "demographics_by_zip": [KEY],
    "neighborhood_profile": [KEY],
    "area_business_by_category": ["area"],
    "trend_business_formation": [KEY, "year"],
    "trend_311_monthly": ["year", "month"],
    "start_histogram": [KEY],
    "place_percentiles": [KEY],
    "place_profiles": [KEY],
    "area_profiles": ["area"],
    "business_age_stats": [KEY],
    "business_age_by_area": ["area"],
    "yearly_series": [KEY],
    "zip_centroids": [KEY],
}

# Tables that a place's profile is put together from, all by place.
CO_LOCATED = [
    "neighborhood_profile",
    "business_by_zip",
    "business_age_stats",
    "momentum_scores",
    "place_percentiles",
    "civic_crime",
    "civic_energy",
    "civic_permit_timelines",
]


class Raw:
    """Source tables of a build, read from the files a config names."""

    def __init__(self, spark: SparkSession, config: Mapping) -> None:
        self.spark = spark
        self.config = config

    def get(self, name: str) -> DataFrame | None:
        config = self.config
        if name == "businesses":
            return self._text("register", lambda df: businesses(df, config["as_of"]))
        if name == "demographics":
            return self._text("census", demographics)
        if name == "gazetteer":
            return self._text("gazetteer", lambda df: df, "\t")
        if name in ("names", "areas", "plans"):
            return self._text(name, lambda df: df)
        path = config.get("tables", {}).get(name)
        return None if path is None else files.read_table(self.spark, path)

    def _text(self, name: str, shape, sep: str = ",") -> DataFrame | None:
        paths = self.config.get(name)
        return None if paths is None else shape(files.read_text_table(self.spark, paths, sep))


def bucketed_parts(spark: SparkSession, get: Callable[[str], DataFrame | None], target: str, buckets: int):
    """Source and store of a job graph in which the parts of a place's profile lie in equal buckets of the place.

    Profiles are then joined and grouped bucket by bucket, without a shuffle.  The civic tables
    among the sources are written once for it.
    """
    write = files.parquet_store(spark, target, CLUSTERED)
    store = files.bucketed_store(spark, target, dict.fromkeys(CO_LOCATED, KEY), buckets, write)

    def source(name: str) -> DataFrame | None:
        found = get(name)
        return store(name, found) if found is not None and name in CO_LOCATED else found

    return source, store


def build(spark: SparkSession, config: Mapping, target: str) -> dict[str, DataFrame]:
    """Write every table whose inputs are present; later tables read the written ones.

    With ``buckets`` in the config, the parts of place profiles are written in so many buckets of the place.
    """
    source, write = Raw(spark, config).get, files.parquet_store(spark, target, CLUSTERED)
    if config.get("buckets"):
        source, write = bucketed_parts(spark, source, target, config["buckets"])

    def store(name: str, df: DataFrame) -> DataFrame:
        return write(name, check_contract(name, df))

    graph = Tables(
        source,
        config["as_of"],
        config["previous_year"],
        config["current_year"],
        config.get("null_policy", "last"),
        config.get("first_year", 2015),
        store,
        tuple(config.get("peers", PEERS)),
        one_scan=True,
    )
    return graph.build_all()


def cluster_layers(spark: SparkSession, tables: Mapping[str, str], target: str) -> dict[str, str]:
    """Write the map layers among the tables along the curve; the paths to open instead."""
    paths = dict(tables)
    for name, _ in LAYERS.values():
        found = files.read_table(spark, paths[name]) if name in paths else None
        if found is not None:
            paths[name] = f"{target.rstrip('/')}/{name}"
            layers.write_layer(found, paths[name])
    return paths


# Civic tables that are asked for one period: the period, and what a period is clustered by.
PERIODS = {
    "civic_crime_detail": ("year", ["offense_group", "crime_against"]),
    "civic_crime_temporal": ("year", ["month", "dow"]),
}


def partition_periods(spark: SparkSession, tables: Mapping[str, str], target: str) -> dict[str, str]:
    """Write the civic tables that are asked by period in one folder per period; the paths to open instead."""
    paths = dict(tables)
    for name, (period, keys) in PERIODS.items():
        found = files.read_table(spark, paths[name]) if name in paths else None
        if found is not None:
            paths[name] = f"{target.rstrip('/')}/{name}"
            files.write_periods(found, paths[name], period, keys)
    return paths


class StoredTables:
    """Built tables under a folder, plus the civic tables a question may need; ``buckets`` as in the build's config."""

    def __init__(
        self,
        spark: SparkSession,
        target: str,
        tables: Mapping[str, str] | None = None,
        peers: tuple[str, str] = PEERS,
        buckets: int | None = None,
    ) -> None:
        self.spark = spark
        self.peers = peers
        self.target = target.rstrip("/")
        self.buckets = buckets
        self.paths = {name: f"{target.rstrip('/')}/{name}" for name in Tables.NAMES}
        self.paths.update({name: path for name, path in (tables or {}).items() if name in SOURCES})
        self._opened: dict[str, DataFrame | None] = {}

    def get(self, name: str) -> DataFrame | None:
        if name not in self._opened:
            path = self.paths.get(name)
            if self.buckets and name in CO_LOCATED:
                self._opened[name] = files.open_bucketed(self.spark, f"{self.target}/{name}", KEY, self.buckets)
            else:
                self._opened[name] = None if path is None else files.read_table(self.spark, path)
        return self._opened[name]

    def __getitem__(self, name: str) -> DataFrame:
        table = self.get(name)
        if table is None:
            raise KeyError(f"table {name} is not available")
        return table


def open_answers(
    spark: SparkSession,
    target: str,
    tables: Mapping[str, str] | None = None,
    peers: tuple[str, str] = PEERS,
    buckets: int | None = None,
) -> Answers:
    """The question layer over built tables."""
    return Answers(StoredTables(spark, target, tables, peers, buckets))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--target", required=True)
    options = parser.parse_args()
    with open(options.config, encoding="utf-8") as handle:
        config = json.load(handle)
    spark = SparkSession.builder.appName("build tables").getOrCreate()
    for name in build(spark, config, options.target):
        print(f"built {name}")


if __name__ == "__main__":
    main()
