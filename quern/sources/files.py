"""Files as tables and back: markdown folders, graph JSON, nested contact exports, JSON lines, text with fields."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import extract_title
from quern.operators.graph import LABELS, valid_edges

FILE = "path string, modificationTime timestamp, length long, content binary"
CONTACTS = (
    "contact_id string, contact_name string, company string,"
    " interactions array<struct<id: string, event_time: string, meeting_type: string, body: string>>"
)
NODE = "id string, label string, name string, vault_path string, summary string"
EDGE = "from_id string, from_label string, to_id string, to_label string, kind string, props map<string, string>"


def with_path(files: DataFrame, folder: str, collection: str) -> DataFrame:
    """(collection, path, title, text, hash, modified_at): paths from the folder on; bytes that are no UTF-8 become marks."""
    base = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/").rsplit("/", 1)
    path = F.substring_index("path", f"{base[0]}/" if len(base) > 1 and base[0] else "file:/", -1)
    text = F.decode("content", "UTF-8")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return files.select(
        F.lit(collection).alias("collection"), path.alias("path"), extract_title(text, stem).alias("title"),
        text.alias("text"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified_at"),
    )


def read_markdown(spark: SparkSession, folder: str, collection: str, glob: str = "*.md", exclude: Sequence[str] = ()) -> DataFrame:
    """Files of a folder and all below it, without paths that hold a part of ``exclude``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = with_path(files, folder, collection)
    for part in exclude:
        rows = rows.where(~F.contains(F.col("path"), F.lit(part)))
    return rows


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Arrays of nodes and of edges in JSON files."""
    return spark.read.schema(NODE).option("multiLine", "true").json(nodes), spark.read.schema(EDGE).option("multiLine", "true").json(edges)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each interaction with a body in an export of contacts."""
    rows = spark.read.schema(CONTACTS).option("multiLine", "true").json(path)
    each = rows.select("contact_id", "contact_name", "company", F.explode("interactions").alias("i")).select("contact_id", "contact_name", "company", "i.*")
    return each.where(F.length(F.btrim("body")) > 0).withColumn("event_date", F.try_to_date(F.left("event_time", F.lit(10)), "yyyy-MM-dd"))


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(folder)


def write_notes(rows: DataFrame, folder: str) -> None:
    """Notes of (title, day, text) as text with a block of fields, partitioned by day."""
    note = F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\ndate: "), F.col("day").cast("string"), F.lit("\n---\n"), F.col("text"))
    rows.select("day", note.alias("value")).write.mode("overwrite").partitionBy("day").option("lineSep", "\n\n").text(folder)


def read_reported(spark: SparkSession, path: str, schema: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON, and (path, record, reason) of what is none: broken JSON, or values of other types than ``schema`` has.

    A record is a line, or with ``whole`` a file that holds an array. Of a broken one nothing is read, and its first 200 characters are told.
    Empty lines are no records.
    """
    fields = f"{schema}, _broken string"
    text = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value").where(F.btrim("value", F.lit(" \t\r\n")) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    if whole:
        read = text.select("path", "value", F.from_json("value", f"array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1: ', x) for x in re.split(r', (?=\w+ )', schema))}>>", {"mode": "PERMISSIVE"}).alias("_rows"))
        good = read.where("_rows IS NOT NULL").select(F.inline("_rows"))
        return good, read.where("_rows IS NULL").select("path", F.left("value", F.lit(200)).alias("record"), F.lit("no array of such records").alias("reason"))
    read = text.select("path", "value", F.from_json("value", fields, options).alias("_row"))
    broken = F.col("_row").isNull() | F.col("_row._broken").isNotNull()
    return read.where(~broken).select("_row.*").drop("_broken"), read.where(broken).select("path", F.left("value", F.lit(200)).alias("record"), F.lit("no such record").alias("reason"))


def load_graph(spark: SparkSession, nodes: str, edges: str, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid nodes and edges of files of arrays, and (source, record, reason) of all that isn't loaded: broken files, nodes and edges with faults.

    A node needs an id and a known label other than Document, which edges make; an id that stands twice has its smallest row.
    """
    found, broken = read_reported(spark, nodes, NODE, whole=True)
    reason = F.when(F.coalesce(F.btrim("id"), F.lit("")) == "", "no id").when(F.col("label") == "Document", "made by edges").when(~F.coalesce(F.col("label").isin(LABELS), F.lit(False)), "unknown label")
    marked = found.withColumn("reason", reason)
    good = marked.where("reason IS NULL").groupBy("id").agg(F.min(F.struct("label", "name", "vault_path", "summary")).alias("_n")).select("id", "_n.*")
    linked, odd = read_reported(spark, edges, EDGE, whole=True)
    fine, wrong = valid_edges(linked, kinds)
    report = broken.select(F.lit("nodes").alias("source"), "record", "reason").unionByName(odd.select(F.lit("edges").alias("source"), "record", "reason"))
    report = report.unionByName(marked.where("reason IS NOT NULL").select(F.lit("nodes").alias("source"), F.coalesce("id", F.lit("?")).alias("record"), "reason"))
    return good, fine, report.unionByName(wrong.select(F.lit("edges").alias("source"), F.concat(F.coalesce("from_id", F.lit("?")), F.lit(" -> "), F.coalesce("to_id", F.lit("?"))).alias("record"), "reason"))
