"""From raw documents to packed training sequences: five stages over the operators of civicscope.llm.

Every stage takes all rows that the one before kept; all but the last return the columns of
``documents``.  Rows with a null id or text go through the stages like empty ones and are
dropped only by a classifier's decision; repeated rows (same id and text) are judged alike and
stay together; rows that share an id but not the text are never dropped as near copies, so no
text is lost to another's id; of equal scores, texts and ids none is preferred to its twin;
texts of any length are read whole; extra columns are carried along up to packing; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicscope.llm import line_templates, order_minhash, packing, quality, toxicity
from civicscope.llm.frames import reach, stored


#: Words whose ids a packing task remembers: workers still hold what earlier stages left them.
REMEMBERED = 150_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not call toxic."""
    model = toxicity.fit(docs, reach(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, score_col="_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not call poor."""
    model = quality.fit(docs, reach(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, score_col="_quality").filter("_quality >= 0.3").drop("_quality")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template an earlier document has; n_chars follows the text."""
    reach(spark)
    less = line_templates.drop_recurring_lines(docs)
    return less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; all rows of an id with several texts."""
    reach(spark)
    said = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.groupBy("doc_id").agg(F.min(said).alias("low"), F.max(said).alias("high")).filter("low <> high").select("doc_id")
    others = order_minhash.near_classes(docs).filter("doc_id <> class_id").select("doc_id").join(several, "doc_id", "left_anti")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    reach(spark)
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, kept=REMEMBERED)
    return packing.pack(cut)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the sketches are not expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    docs = reach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
