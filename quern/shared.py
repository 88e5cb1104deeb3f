"""The shared folder, lineage cuts and size-checked broadcasts that operators use."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; each has a few columns of bounded width.
SMALL_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: later stages survive a lost executor and reread, never recompute."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``rows`` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where fewer files than cores hold them, as a file of one row group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str, build: Callable[[], str]) -> str:
    """The path of what was built from ``df`` under ``name`` and is in the shared folder, or of what ``build`` makes where the table's files have changed since.

    The files' paths, lengths and times stand for their content, as for a scan of the folder.
    """
    spark = df.sparkSession
    files = spark.read.format("binaryFile").load(df.inputFiles()).select("path", "length", F.col("modificationTime").cast("string").alias("at"))
    state = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "at").cast("decimal(38,0)"))).first()
    key = hashlib.sha256(repr((name, tuple(state))).encode()).hexdigest()[:32]
    pointer = f"{shared_dir(spark).rstrip('/')}/stored-{key}"
    try:
        return spark.read.schema("path string").parquet(pointer).first().path
    except AnalysisException:  # none is there
        path = build()
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("ignore").parquet(pointer)
        return path


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank``, the number of each row from 1 in that order, of which no two rows are equal: ranges are sorted apart and their sizes summed."""
    bits = 33  # below them is a row's place in its partition
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", bits), F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return placed.withColumn("_part", part).withColumn("_place", place).join(F.broadcast(sizes.withColumn("_before", before)), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_at", "_part", "_place", "_n", "_before")
