"""A keyed table in hash partitions: batches of changes rewrite only the partitions in which a row changes, and a repeated batch changes nothing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import frontmatter_map, slugify
from quern.operators.graph import WIKILINK, shown_name
from quern.shared import cut

#: Partitions of a new table; a large one takes more, as a change rewrites the whole of one.
BUCKETS = 64
DELETED = "_deleted"


@dataclass(frozen=True)
class Report:
    """Rows of a batch by what became of them, and the partitions that were rewritten (or would be)."""

    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    unchanged: int = 0
    buckets: tuple[int, ...] = ()


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one of the largest ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


class Store:
    """The table under ``path``, of ``schema``, one row for each value of ``keys`` (nulls are values too).

    ``data/batch=N/bucket=K`` holds the partition K that batch N wrote; ``manifest/version=N`` names the folder of each partition.
    A batch writes its partitions and then its manifest, so readers see a whole batch or none of it, and a batch that failed on
    the way is repeated under its number and overwrites what it left.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> list[int]:
        """Numbers of the batches that wrote a manifest, in order."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        found = [x.getPath() for x in system.listStatus(folder) if x.getPath().getName().startswith("version=")]
        return sorted(int(x.getName().split("=")[1]) for x in found if system.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def manifest(self, before: int | None = None) -> dict[int, str]:
        """The folder of each partition that has rows, by the last batch (before a number); at most one entry a partition."""
        known = [n for n in self.versions() if before is None or n < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/manifest/version={known[-1]}").collect()
        return {r.bucket: r.folder for r in rows}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{x}" for x in folders])

    def rows(self, before: int | None = None) -> DataFrame:
        """The table after the last batch (before a number)."""
        return self._read(list(self.manifest(before).values()))

    def apply(self, changes: DataFrame, batch: int, order: Sequence[str] | None = None, dry_run: bool = False) -> Report:
        """Upsert ``changes``, which have the table's columns, and drop rows where ``_deleted`` is true; of equal keys the largest ``order`` counts.

        Only partitions that ``changes`` have keys of are read, and those written in which a row is new, other or gone. If there is none
        no version is written. Rows equal in that too, or without ``order``, are ranked by their columns. With ``dry_run`` nothing is written.
        """
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in changes.columns else F.lit(False)
        ranks = [F.col(f"`{c}`").alias(f"_order{k}") for k, c in enumerate(order or [])]
        given = changes.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], gone.alias(DELETED), *ranks)
        by = [f"_order{k}" for k in range(len(ranks))]
        given = cut(last_of(given, self.keys, [*by, *names, DELETED]).drop(*by).withColumn("_bucket", bucket))
        asked = {r._bucket for r in given.select("_bucket").distinct().collect()}  # one a partition at most
        known = self.manifest(before=batch)
        old = self._read([known[b] for b in sorted(asked & known.keys())]).withColumn("_bucket", bucket)
        same_key = F.lit(True)
        for c in self.keys:
            same_key = same_key & F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
        pack = lambda df, tag: df.select(*self.keys, "_bucket", F.struct(*names).alias(tag), *([DELETED] if tag == "new" else []))
        both = pack(old, "old").alias("o").join(pack(given, "new").alias("n"), (F.col("o._bucket") == F.col("n._bucket")) & same_key, "full_outer")
        is_old, is_new = F.col("old").isNotNull(), F.col("new").isNotNull()
        action = (
            F.when(~is_new, "kept").when(F.col(DELETED), F.when(is_old, "deleted").otherwise("absent"))
            .when(~is_old, "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
        )
        judged = both.select(F.coalesce("o._bucket", "n._bucket").alias("bucket"), action.alias("_action"), F.when(action.isin("inserted", "updated"), F.col("new")).otherwise(F.col("old")).alias("_row"))
        counts = judged.groupBy("bucket", "_action").count().collect()  # at most five rows a partition
        total = lambda a: sum(r["count"] for r in counts if r["_action"] == a)
        touched = sorted({r.bucket for r in counts if r["_action"] in ("inserted", "updated", "deleted")})
        report = Report(total("inserted"), total("updated"), total("deleted"), total("unchanged") + total("absent"), tuple(touched))
        if dry_run or not touched:
            return report
        stays = judged.where(F.col("bucket").isin(touched) & (F.col("_action") != "deleted") & F.col("_row").isNotNull())
        stays.select("bucket", "_row.*").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        left = {r.bucket for r in counts if r["_action"] not in ("deleted", "absent")}
        folders = {b: f for b, f in known.items() if b not in touched} | {b: f"batch={batch}/bucket={b}" for b in touched if b in left}
        lines = [json.dumps({"bucket": b, "folder": f}) for b, f in sorted(folders.items())]
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={batch}")
        return report


#: Folders of a vault whose entries are entities, with their label (fixed values).
VAULT_FOLDERS = [
    (r"(?:^|/)02-Areas/00-Clients/([^/]+)/[^/]+\.md$", "Organisation"),
    (r"(?:^|/)02-Areas/Network/People-Notes/([^/]+)\.md$", "Person"),
    (r"(?:^|/)05-Knowledge/01-Domain-Outcomes/([^/]+)\.md$", "Outcome"),
]
NODE = "id string, label string, name string, vault_path string"
EDGE = "from_id string, to_id string, kind string"


def crawled(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that the ``notes`` (path, text) of a vault tell: entities by their folders, where persons work, and links to known entities.

    An entity's name is that of its fields, or its file's or folder's; its id is the name's slug, and of several notes with one id the first path
    counts. Links to anything else are dropped.
    """
    stems = F.array(*[F.struct(F.regexp_extract("path", p, 1).alias("stem"), F.lit(label).alias("label")) for p, label in VAULT_FOLDERS])
    read = notes.select("path", "text", frontmatter_map(F.col("text")).alias("_fields"), F.get(F.filter(stems, lambda x: x["stem"] != ""), F.lit(0)).alias("_of"))
    field = lambda name: F.nullif(F.btrim(F.try_element_at("_fields", F.lit(name))), F.lit(""))
    named = read.where("_of IS NOT NULL").select("path", F.col("_of.label").alias("label"), F.coalesce(field("name"), shown_name(F.col("_of.stem"))).alias("name"), field("org").alias("org"))
    named = named.withColumn("id", slugify(F.col("name"))).where("id <> ''")
    nodes = cut(named.groupBy("id").agg(F.min_by(F.struct("label", "name", F.col("path").alias("vault_path"), "org"), "path").alias("_n")).select("id", "_n.*"))
    known = nodes.select(F.col("id").alias("to_id"), F.col("label").alias("_label"))
    works = nodes.where("label = 'Person' AND org IS NOT NULL").select(F.col("id").alias("from_id"), slugify(F.col("org")).alias("to_id")).join(known.where("_label = 'Organisation'"), "to_id")
    links = read.select("path", F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("_link")).select(F.col("path").alias("from_id"), slugify(F.col("_link")).alias("to_id")).join(known, "to_id")
    edges = works.select("from_id", "to_id", F.lit("WORKS_AT").alias("kind")).unionByName(links.select("from_id", "to_id", F.lit("MENTIONS").alias("kind")))
    return nodes.select("id", "label", "name", "vault_path"), edges.distinct()


def crawl_into(nodes: Store, edges: Store, notes: DataFrame, batch: int, dry_run: bool = False) -> tuple[Report, Report]:
    """Upsert what the notes tell into a store of nodes and one of edges; with ``dry_run`` only the reports are made."""
    found, linked = crawled(notes)
    return nodes.apply(found, batch, dry_run=dry_run), edges.apply(linked, batch, dry_run=dry_run)
