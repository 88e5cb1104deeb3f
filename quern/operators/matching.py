"""Retrieval metrics against gold lists of titles and paths, as tables of results and of gold entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def note_key(name: Column) -> Column:
    """Lower case, runs of spaces, hyphens and underscores as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[-_\s]+", "-"), F.lit("-"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def matches(ref: Column, path: Column) -> Column:
    """Whether a result's path is what a gold entry names: a path by its end, a title by the file's name."""
    bare = F.regexp_replace(ref, r"\.md$", "")
    by_end = F.endswith(note_key(F.replace(path, F.lit(".md"), F.lit(""))), note_key(bare))
    return F.when(F.contains(bare, F.lit("/")), by_end).otherwise(note_key(file_stem(path)) == note_key(bare))


def first_of_each(ranked: DataFrame) -> DataFrame:
    """``ranked`` (query_id, rank, path) without later repeats of a path, ranks closed up."""
    once = ranked.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def _dcg(rel: Column, place: Column) -> Column:
    return F.sum(rel / F.log2(place + 1.0))


def _per_query(queries: DataFrame, *parts: DataFrame) -> DataFrame:
    out = queries.select("query_id").distinct()
    for part in parts:
        out = out.join(part, "query_id", "left")
    return out


def graded(queries: DataFrame, ranked: DataFrame, gold: DataFrame, k: int = 10, hit: int = 5) -> DataFrame:
    """(query_id, ndcg, hit, rr): graded metrics of each query, 0 without gold or results.

    ``ranked`` is (query_id, rank, path), ``gold`` (query_id, pos, ref, rel). Repeated paths go before the cut at ``k``. A
    result gains the relevance of the first gold entry that it matches, so several results of one entry gain each and
    ndcg may exceed 1; it is a hit if it matches any entry of relevance 1 or more.
    """
    results = first_of_each(ranked).where(F.col("rank") <= k)
    named = gold.where(F.coalesce("ref", F.lit("")) != "")
    met = (
        results.join(named, "query_id").where(matches(F.col("ref"), F.col("path"))).groupBy("query_id", "rank")
        .agg(F.min_by("rel", "pos").alias("rel"), F.max("rel").alias("best"))
    )
    found = met.groupBy("query_id").agg(
        _dcg(F.col("rel"), F.col("rank")).alias("_dcg"), F.max(((F.col("rank") <= hit) & (F.col("best") >= 1)).cast("int")).alias("_hit"),
        F.min(F.when(F.col("best") >= 1, F.col("rank"))).alias("_first"),
    )
    best = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "pos")
    ideal = gold.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy("query_id").agg(_dcg(F.col("rel"), F.col("_n")).alias("_ideal"))
    return _per_query(queries, found, ideal).select(
        "query_id", F.round(F.when(F.col("_ideal") > 1e-9, F.coalesce("_dcg", F.lit(0.0)) / F.col("_ideal")).otherwise(0.0), 6).alias("ndcg"),
        F.coalesce("_hit", F.lit(0)).alias("hit"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("rr"),
    )


def binary(queries: DataFrame, ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, hit, mrr) where gold (query_id, path) is relevant or not, by the path in lower case.

    Only ndcg drops repeated paths; mrr looks at all results.
    """
    plain = lambda c: F.replace(F.lower(c), F.lit("\\"), F.lit("/"))
    wanted = gold.select("query_id", plain(F.col("path")).alias("_path"))
    known = wanted.distinct()
    in_gold = lambda rows: rows.withColumn("_path", plain(F.col("path"))).join(known, ["query_id", "_path"], "left_semi")
    gained = in_gold(first_of_each(ranked)).where(F.col("rank") <= k).groupBy("query_id").agg(_dcg(F.lit(1.0), F.col("rank")).alias("_dcg"))
    seen = in_gold(ranked).groupBy("query_id").agg(F.min("rank").alias("_first"))
    n = wanted.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_n")), F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1.0))
    return _per_query(queries, gained, seen, n).select(
        "query_id", F.round(F.when(F.col("_n").isNull(), 0.0).otherwise(F.coalesce("_dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
        F.coalesce((F.col("_first") <= k).cast("int"), F.lit(0)).alias("hit"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"),
    )


def substring_scores(queries: DataFrame, ranked: DataFrame, gold: DataFrame, exact: int = 5, fuzzy: int = 10) -> DataFrame:
    """(query_id, exact, fuzzy): 1 if any gold ref is part of one of the first paths, in any case."""
    named = gold.where(F.coalesce("ref", F.lit("")) != "").select("query_id", F.lower("ref").alias("_ref"))
    held = ranked.where(F.col("rank") <= max(exact, fuzzy)).join(named, "query_id").where(F.contains(F.lower("path"), F.col("_ref")))
    best = held.groupBy("query_id").agg(F.min("rank").alias("_first"))
    within = lambda n: F.coalesce((F.col("_first") <= n).cast("double"), F.lit(0.0))
    return _per_query(queries, best).select("query_id", within(exact).alias("exact"), within(fuzzy).alias("fuzzy"))
