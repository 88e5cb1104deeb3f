"""The given tables in the shape that the operators read, and the same shape in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import content_hash, token_estimate
from quern.operators.inverted import Index, stored_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a path, a collection (their source) and a content hash; columns that aren't used are not read."""
    return table(spark, sf_dir, "documents").withColumns({
        "path": F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))),
        "collection": F.col("source"),
        "hash": content_hash(F.col("text")),
    })


DOCS = """docs AS (SELECT *, source || '/' || lang || '/' || doc_id || '.md' AS path, source AS collection,
  sha256(coalesce(text, '')) AS hash FROM documents)"""


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored inverted index of all documents, with each one's estimate of tokens; documents of a language and source share shards."""
    return stored_index(table(spark, sf_dir, "documents"), "documents", ["lang", "source"], {"tokens": token_estimate(F.col("text"))})


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as a batch of queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Six intents in the order in which rules try them, the last one as default (fixed values).
INTENTS = ["temporal", "multi_hop", "entity", "procedural", "keyword", "semantic"]
