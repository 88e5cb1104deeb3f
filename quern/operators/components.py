"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of the edges (a, b): the smallest id that it is linked with over any number of steps.

    In turn, every id links its larger neighbours to its smallest one, then its smaller neighbours, until nothing
    changes. Each round is written to the shared folder; the driver sees a count and a checksum.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("_low"))
        linked = large.join(down, "a").select(F.when(F.col("b") == F.col("_low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_low").alias("b"))
        edges = cut(linked.where(F.col("a") != F.col("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
