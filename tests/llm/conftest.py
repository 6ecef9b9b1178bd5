import pytest
from pyspark.sql import functions as F

from civicscope.llm.frames import reach

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "x", 1.0),
    (2, "", "y", None),
    (3, None, None, 2.0),
    (4, "one", "x", 3.0),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "x", 1.0),
    (6, "long text " * 4000 + "\nend", "z", 0.0),
    (7, "  spaced \t out\r\n\n text with 中文 and \U0001f600 <|endoftext|> ", "z", 0.0),
    (7, "  spaced \t out\r\n\n text with 中文 and \U0001f600 <|endoftext|> ", "z", 0.0),
    (None, "a row without an id", "z", 0.0),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with outputs."""
    reach(spark)
    df = spark.createDataFrame(EDGES, "doc_id long, text string, score string, length double")
    return df.withColumn("ids", F.lit("clash")).withColumn("n_dropped", F.lit("clash")).cache()


@pytest.fixture(scope="session")
def small(spark):
    reach(spark)
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
