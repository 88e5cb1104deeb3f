"""Continuous ingest of markdown files into a keyed table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.sources.files import FILE, with_path
from quern.streaming.store import Store

DOCUMENT = "collection string, path string, title string, text string, hash string, modified_at timestamp"


def documents_store(spark: SparkSession, table: str) -> Store:
    """The table of documents under ``table``, keyed by collection and path."""
    return Store(spark, table, DOCUMENT, ["collection", "path"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, collection: str, glob: str = "*.md") -> StreamingQuery:
    """Upsert files of a folder, as they come, into the table of documents under ``table``; of a path the last file counts.

    Each batch rewrites only the partitions in which a document changes, under its own number, so that a repeated batch writes
    the same and readers never see half of one. Deletions need a listing: see ``operators.corpus.soft_delete``.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        documents_store(batch.sparkSession, table).apply(with_path(batch, folder, collection), number, ["modified_at", "hash"])

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The documents after the last batch (before a number), or None if there is none."""
    store = documents_store(spark, table)
    return store.rows(before) if any(before is None or n < before for n in store.versions()) else None
