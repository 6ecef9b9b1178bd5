"""Helpers shared by the operators of this subpackage: Arrow batches, word chunks, stored frames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicscope.operators.relations import shared_folder

#: Text bytes that one call of a batch function gets at most (one longer row still comes whole).
BATCH_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python: texts may be very long.
ARROW_BYTES = 4 << 20


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound their batches.

    On a cluster the package comes with ``--py-files`` or the image; a path that is
    missing there does no harm.
    """
    if "arrow.maxBytesPerBatch" not in spark.sparkContext.getConf().toDebugString():  # else it is the user's choice
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    here = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in here.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{here}" if here else root
    return spark


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet into the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key) -> F.Column:
    """Whether crc32 of the key as text leaves no remainder modulo 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text (or number of list entries) reaches a size."""
    if batch.num_rows == 0:
        return
    array = batch.column(batch.schema.get_field_index(text))
    length = pc.list_value_length(array) if pa.types.is_list(array.type) else pc.binary_length(array)
    sizes = pc.fill_null(length, 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def append(df: DataFrame, text: str, fields: list[T.StructField], made: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Add columns computed from Arrow batches; a column of ``df`` with the name of a new one is replaced."""
    reach(df.sparkSession)
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new or f.name == text]
    if any(f.name in new for f in keep):
        raise ValueError(f"a new column may not be named like the text column {text!r}")
    names = [f.name for f in keep] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                old = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays(old + made(batch), names=names)

    return df.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, T.StructType(keep + fields))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def whole_text(array: pa.Array) -> pa.Array:
    """Strings with null as the empty text."""
    return pc.fill_null(array.cast(pa.string()), "")


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Split at spaces and line ends: offsets of each text's chunks, index of each chunk, the distinct chunks."""
    lists = pc.split_pattern(pc.replace_substring(whole_text(texts), "\n", " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets; empty ranges give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
