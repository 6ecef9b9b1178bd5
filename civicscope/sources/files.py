"""Readers and writers for text files and Parquet tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from civicscope.operators.relations import row_of


def read_text_table(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Delimited files with a header, every column a string.

    Several paths may have different layouts: columns are matched by name and a
    column missing from a file is NULL there.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.csv(p, header=True, inferSchema=False, sep=sep) for p in listed]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_key_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows whose text key is a whole number within the range."""
    return df.filter(F.trim(F.col(f"`{key}`")).try_cast("int").between(low, high))


def lookup_table(spark: SparkSession, entries: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A two-column table from a small mapping."""
    return spark.createDataFrame(list(entries.items()), f"{key} string, {value} string")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def file_listing(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, modified, bytes) of the files under a path, without opening them; None if absent."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise
    return files.select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, None when it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def read_catalogue(spark: SparkSession, catalogue: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of a name -> path catalogue that exist."""
    found = {name: read_table(spark, path) for name, path in catalogue.items()}
    return {name: df for name, df in found.items() if df is not None}


def dataset_health(spark: SparkSession, catalogue: Mapping[str, str]) -> DataFrame:
    """(dataset, available, files, modified) per catalogue entry."""
    parts = []
    for name, path in catalogue.items():
        files = file_listing(spark, path)
        if files is None:
            row = spark.range(1).select(
                F.lit(0).cast("bigint").alias("files"), F.lit(None).cast("timestamp").alias("modified")
            )
        else:
            row = files.agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("modified"))
        parts.append(row.select(F.lit(name).alias("dataset"), (F.col("files") > 0).alias("available"), "files", "modified"))
    return reduce(DataFrame.unionByName, parts)


def dataset_rows(spark: SparkSession, catalogue: Mapping[str, str], dates: Mapping[str, str]) -> DataFrame:
    """(dataset, available, row_count, newest) of each table: its rows and the greatest value of its date column."""
    parts = []
    for name, path in catalogue.items():
        table = read_table(spark, path)
        if table is None:
            table, newest = spark.createDataFrame([], "x int"), F.lit(None).cast("date")
            found = F.lit(False)
        else:
            newest = F.max(F.col(dates[name]).cast("date")) if name in dates else F.lit(None).cast("date")
            found = F.lit(True)
        parts.append(table.agg(F.count(F.lit(1)).alias("row_count"), newest.alias("newest")).select(
            F.lit(name).alias("dataset"), found.alias("available"), "row_count", "newest"))
    return reduce(DataFrame.unionByName, parts)


def health_summary(health: DataFrame) -> DataFrame:
    """One row: 'ok' when any dataset is available, and the date of the newest file."""
    status = F.when(F.max("available"), "ok").otherwise("no_data")
    return health.agg(status.alias("status"), F.max("modified").cast("date").alias("data_as_of"))


def with_data_date(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach the data date to every row."""
    return df.withColumn("data_as_of", row_of(summary)["data_as_of"])


def write_sorted(
    df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, mode: str = "overwrite"
) -> int:
    """Write Parquet (zstd) range-clustered on the keys and return the row count.

    Clustering gives narrow min/max statistics per file, so key filters skip files.
    The count is observed during the write (after the range sampling, which reads
    the input once more), so the written data is not read again.
    """
    seen = Observation()
    parts = [files, *keys] if files else list(keys)
    (
        df.repartitionByRange(*parts)
        .sortWithinPartitions(*keys)
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .option("compression", "zstd")
        .parquet(path)
    )
    return seen.get["rows"]


def write_periods(df: DataFrame, path: str, period: str, keys: Sequence[str]) -> DataFrame:
    """Write Parquet (zstd) with one folder per period, clustered on the keys inside, and open it.

    A filter on the period, known or found by a subquery as ``relations.latest`` does, then
    opens the folders of that period only.  Ranges of (period, keys) are the tasks, so a
    period with most of the rows is written by several.  Rows without a period have a
    folder of their own.  An empty table leaves no files: the returned frame is empty,
    ``read_table`` takes it for absent.
    """
    (
        df.repartitionByRange(period, *keys)
        .sortWithinPartitions(period, *keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy(period)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def refresh_copy(
    spark: SparkSession, catalogue: Mapping[str, tuple[str, str]], force: bool = False
) -> dict[str, str]:
    """Copy name -> (source, target) tables whose source files are newer than the target.

    Returns 'missing', 'current' or 'copied' per name.
    """
    outcome = {}
    for name, (source, target) in catalogue.items():
        files = file_listing(spark, source)
        if files is None:
            outcome[name] = "missing"
            continue
        existing = file_listing(spark, target)
        if existing is not None and not force:
            newest = [f.agg(F.max("modified")).first()[0] for f in (files, existing)]
            if newest[1] is not None and newest[0] <= newest[1]:
                outcome[name] = "current"
                continue
        spark.read.parquet(source).write.mode("overwrite").option("compression", "zstd").parquet(target)
        outcome[name] = "copied"
    return outcome


def parquet_store(spark: SparkSession, root: str, keys: Mapping[str, Sequence[str]]):
    """Store for the job graph: write a table under ``root`` and read it back."""

    def store(name: str, df: DataFrame) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        if keys.get(name):
            write_sorted(df, path, keys[name])
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def bucketed_name(path: str) -> str:
    """The catalogue name of a bucketed table: it follows from the path, so every session finds the same one."""
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame | None:
    """A table that ``write_bucketed`` wrote, with its layout known to the planner; None if absent.

    Only the session's catalogue knows that files are buckets, so a session that did not write
    them registers them first.
    """
    name = bucketed_name(path)
    if not spark.catalog.tableExists(name):
        plain = read_table(spark, path)
        if plain is None:
            return None
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write one sorted file per bucket of ``key`` and return the table.

    Joins and groups by ``key`` (alone or with more columns) over tables of the same number of buckets
    need no shuffle.  For tables with few rows per key: a bucket is one task's work.
    """
    spark, name = df.sparkSession, bucketed_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # The shuffle's hash is the one that buckets use: every task writes one whole bucket.
    placed = df.repartition(buckets, F.col(f"`{key}`"))
    written = placed.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
    written.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def bucketed_store(spark: SparkSession, root: str, keys: Mapping[str, str], buckets: int, plain: Callable[[str, DataFrame], DataFrame]):
    """Store for the job graph: tables with a key in ``keys`` go to buckets of it, others to the ``plain`` store."""

    def store(name: str, df: DataFrame) -> DataFrame:
        if name not in keys:
            return plain(name, df)
        return write_bucketed(df, f"{root.rstrip('/')}/{name}", keys[name], buckets)

    return store
