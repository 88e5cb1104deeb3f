"""A training-data pipeline of five stages over ``documents``, each written as Parquet before the next reads it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further columns of any
name, and keeps the columns that it isn't about as they are. What each does with them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.jaccard_join import one_of_each
from quern.llm.line_dedup import line_dedup
from quern.llm.mixing import mixed_documents
from quern.llm.packing import pack
from quern.llm.shared import cut
from quern.llm.tokens import ByteEncoder, public
from quern.llm.toxicity import THRESHOLD, fit, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, learned from ``labels``, scores below the threshold; a null or empty text has the model's bias."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model, "_toxicity").where(F.col("_toxicity") < THRESHOLD).drop("_toxicity")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with lines that many documents share in one of them only; ``n_chars`` counts what is left.

    A null text becomes the empty one.
    """
    left = line_dedup(docs).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest doc_id (null below every other); texts without words stay."""
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of each source as often as its target asks for, up to twice; a null source is the last one, a null text has no words."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows and their places in sequences; a null or empty text is its end id alone."""
    return pack(docs, ByteEncoder(public("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]
#: Toxicity is a learned score, which SQL can't express; tests/llm/test_pipeline.py holds each stage against SQL or Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
