"""Load only the files that arrived since the last run, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from civicscope.operators import counts, sketches
from civicscope.plans.contracts import contract
from civicscope.plans.tables import KEY
from civicscope.sources import files


def _where(spark: SparkSession, source: str) -> tuple[str, str]:
    """The folder to watch and the names that count in it: a streaming source takes folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return (source, "*.parquet") if status.isDirectory() else (source.rsplit("/", 1)[0], source.rsplit("/", 1)[1])


def _arrivals(spark: SparkSession, source: str, schema: StructType, max_files: int) -> DataFrame:
    folder, names = _where(spark, source)
    watched = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", max_files)
    return watched.parquet(folder)


def load_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType,
    max_files: int = 1000,
) -> DataFrame:
    """Append new Parquet files of a table, one file or a folder, to a target table and return the target.

    The checkpoint remembers the files already taken, so a rerun after a lost
    driver or executor neither skips nor repeats any; the file sink commits each
    batch once.
    """
    query = (
        _arrivals(spark, source, schema, max_files).writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)


def _extend(
    spark: SparkSession, source: str, root: str, needed: StructType, name: str, make: Callable[[DataFrame], DataFrame], max_files: int
) -> DataFrame | None:
    """What ``make`` says about every batch of new files, each in ``root/name/batch=<number>``; None without files."""
    folder = f"{root.rstrip('/')}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={number}")

    started = (
        _arrivals(spark, source, needed, max_files)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{root.rstrip('/')}/_seen")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return files.read_table(spark, folder)


def extend_cube(
    spark: SparkSession, source: str, root: str, schema: StructType, max_files: int = 1000
) -> DataFrame:
    """Count the businesses in new Parquet files of a table into the cube under ``root``; all its cubes as one frame.

    Only new files are read.  Each batch of them leaves a cube of its own in
    ``root/cube/batch=<number>``, written over if a lost driver made the batch run
    again, so no row counts twice; ``root/_seen`` remembers the files.  Rows are
    cleaned businesses (of ``schema``, extra columns are not read); a business that
    is in two files counts twice.  The frame is what ``Tables`` takes as source
    ``business_cube``, or ``counts.merged_cube`` adds up; no files give an empty one.
    """
    needed = StructType([field for field in schema if field.name in (KEY, "category", "status", "start_date")])
    found = _extend(spark, source, root, needed, "cube", lambda batch: counts.business_cube(batch, KEY), max_files)
    wanted = contract("business_cube")
    return spark.createDataFrame([], wanted) if found is None else found.select(*wanted.names)


def extend_sketches(
    spark: SparkSession, source: str, root: str, schema: StructType, distinct: str = "business_name", max_files: int = 1000
) -> DataFrame:
    """Sketches per (place, category) of the businesses in new files, kept under ``root`` like the cubes; all of them.

    ``sketches.merged_sketches`` merges them to any coarser group.  A business in two files is one
    distinct value, but two starts.
    """
    by = [KEY, "category"]
    needed = StructType([field for field in schema if field.name in (*by, "status", "start_date", distinct)])

    def make(batch: DataFrame) -> DataFrame:
        return sketches.business_sketches(batch, by, distinct)

    found = _extend(spark, source, root, needed, "sketches", make, max_files)
    wanted = contract("business_sketches")
    return spark.createDataFrame([], wanted) if found is None else found.select(*wanted.names)
