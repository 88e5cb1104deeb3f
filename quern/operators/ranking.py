"""Full-text, keyword and vector retrieval of batches of queries, rank fusion, boosts and budgets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions.stemming import stems
from quern.functions.text import STOP_WORDS, exploded_tokens, finite, split_words, tokens
from quern.shared import cut, small, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def top(df: DataFrame, k: int, score: str, *ties: str, by: str = "query_id") -> DataFrame:
    """The ``k`` rows of each query with the largest score, with their ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), *[F.col(c) for c in ties])
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, every_term: bool = False, prefix: bool = False, stemmed: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents by BM25, ties to smaller ids.

    ``docs`` is (doc_id, text), ``queries`` (query_id, text). Documents are tokenised once: terms that are asked for are
    counted by document, all others together, and these postings are written; sizes, document frequencies and scores are
    read from them. A document matches with any term, or with ``every_term``; with ``prefix`` a term stands for all that
    begin with it, with ``stemmed`` for all of its stem, counted as one; both take a scan for the vocabulary before.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked"))
    words = exploded_tokens(spread(docs.select("doc_id", "text")))
    if stemmed:
        own = stems(asked.select("asked"), "asked")
        asked = asked.join(small(own), "asked").select("query_id", F.col("stem").alias("asked")).distinct()
        known = cut(stems(words.select("term")).join(small(own.select("stem").distinct()), "stem").select(F.col("stem").alias("asked"), "term"))
    elif prefix:
        vocabulary = words.select("term").distinct()
        starts = asked.select("asked").distinct()
        begins = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.left(F.col("term"), n))
        known = cut(vocabulary.where(F.col("term").isNotNull()).select("term", F.explode(begins).alias("asked")).join(small(starts), "asked").select("asked", "term"))
    else:
        known = asked.select("asked", F.col("asked").alias("term")).distinct()
    wanted = small(known.select("term", F.lit(True).alias("_wanted")).distinct())
    postings = cut(
        words.join(wanted, "term", "left").groupBy(F.when(F.col("_wanted"), F.col("term")).alias("term"), "doc_id").agg(F.count("*").alias("tf"))
    )
    sizes = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    n = docs.count()
    mean = (postings.agg(F.sum("tf")).first()[0] or 0) / n if n else 1.0
    mean = mean or 1.0
    tf = postings.where(F.col("term").isNotNull()).join(sizes, "doc_id")
    if stemmed:
        tf = tf.join(small(known), "term").groupBy(F.col("asked").alias("term"), "doc_id", "dl").agg(F.sum("tf").alias("tf"))
        known = known.select("asked", F.col("asked").alias("term")).distinct()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / float(mean)))
    hits = tf.join(small(df), "term").join(small(known), "term").select("asked", "doc_id", weight.alias("w"))
    scored = (
        hits.join(small(asked), "asked").groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("w"), 6).alias("score"), F.countDistinct("asked").alias("_met"))
    )
    if every_term:
        scored = scored.join(asked.groupBy("query_id").agg(F.count("*").alias("_terms")), "query_id").where(F.col("_met") == F.col("_terms")).drop("_terms")
    scored = scored.drop("_met").withColumn("score", finite(F.col("score")))
    return top(scored, k, "score", "doc_id") if k else scored


#: Documents that one task reads about, and queries that it asks at most, in a search by beginnings.
SCAN_DOCS, SCAN_QUERIES = 2_048, 4_096
_STOP = frozenset(STOP_WORDS)


def _begun(asked: pa.Table, docs: pa.Table, counts: bool, others: bool) -> list[list]:
    """Columns query_id, doc_id, term, weight, tf, dl of the documents that hold, for every word of a query, a term that begins with it.

    ``weight`` is the number of the query's words that the term begins with. With ``counts`` follow, without a query, the documents of each term as ``tf`` (with
    ``others`` of those too that no word begins) and all words as ``dl``.
    """
    asked = asked.sort_by([("query_id", "ascending"), ("asked", "ascending")])
    given = asked["query_id"].to_pylist()
    words = {w: k for k, w in enumerate(dict.fromkeys(asked["asked"].to_pylist()))}
    at = np.array([words[w] for w in asked["asked"].to_pylist()], np.int64)
    starts = np.array([k for k in range(len(given)) if not k or given[k] != given[k - 1]], np.int64)
    ends = np.append(starts[1:], len(given))
    begins: dict[str, list[int]] = {}
    held: Counter = Counter()
    out: list[list] = [[], [], [], [], [], []]
    total = 0
    for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        found = Counter(t for t in re.findall("[a-z0-9]+", text or "") if len(t) >= 2 and t not in _STOP)
        size = found.total()
        total += size
        held.update(found.keys())
        here = np.zeros(len(words), bool)
        for t in found:
            if t not in begins:
                begins[t] = [words[t[:n]] for n in range(2, len(t) + 1) if t[:n] in words]
            here[begins[t]] = True
        for q in np.flatnonzero(np.logical_and.reduceat(here[at], starts)).tolist() if len(starts) else []:
            own = set(at[starts[q] : ends[q]].tolist())
            for t, tf in found.items():
                if weight := sum(w in own for w in begins[t]):
                    for column, value in zip(out, (given[starts[q]], doc_id, t, weight, tf, size), strict=True):
                        column.append(value)
    if counts:
        every = [(None, None, t, 0, n, 0) for t, n in held.items() if others or begins[t]] + [(None, None, None, 0, 0, total)]
        for column, values in zip(out, zip(*every, strict=True), strict=True):
            column.extend(values)
    return out


def begins_with_all(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents by BM25 of those that hold, for each of a query's words, a term that begins with it.

    The same rows as of :func:`bm25` with ``every_term`` and ``prefix``, for long queries. A short word begins a great part of the vocabulary, so neither
    words and terms nor words and postings are paired: a task reads some documents once and keeps only those that hold all words of a
    query, with their terms, and how many documents hold each term.
    """
    asked = cut(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("asked")).distinct())
    n, m = docs.count(), asked.select("query_id").distinct().count()
    parts, query_parts = max(1, -(-n // SCAN_DOCS)), max(1, -(-m // SCAN_QUERIES))
    asked = asked.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    sent = asked.crossJoin(docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")))
    read = spread(docs.select("doc_id", "text")).select("doc_id", F.lower("text").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    read = read.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    found_schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("term", StringType()), *(StructField(c, LongType()) for c in ("weight", "tf", "dl"))])
    made = to_arrow_schema(found_schema)

    def meet(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(_begun(asked, docs, key[1].as_py() == 0, query_parts > 1), made.types, strict=True)], made)

    found = cut(read.groupBy("part", "query_part").cogroup(sent.groupBy("part", "query_part")).applyInArrow(meet, found_schema))
    mean = ((found.where("query_id IS NULL AND term IS NULL").agg(F.sum("dl")).first()[0] or 0) / n if n else 1.0) or 1.0
    hits = found.where("query_id IS NOT NULL")
    df = found.where("query_id IS NULL AND term IS NOT NULL").join(small(cut(hits.select("term").distinct())), "term").groupBy("term").agg(F.sum("tf").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / float(mean)))
    scored = hits.join(small(cut(df)), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, k, "score", "doc_id")


def normalised(score: Column) -> Column:
    return F.abs(score) / (1 + F.abs(score))


KEYWORD = "[a-z0-9]+(?:-[a-z0-9]+)*"


def keywords(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEYWORD), F.lit(0)))


def keyword_overlap(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by the number of distinct query words that a document has, ties to smaller ids."""
    asked = queries.select("query_id", F.explode(keywords(F.col("text"))).alias("word"))
    held = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(keywords(F.col("text"))).alias("word"))
    met = held.join(small(asked), "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return top(met, k, "score", "doc_id")


def nearest_rows(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest finite distances of each row, ties to smaller ids; only what reaches the k-th is sorted."""
    distance[np.isnan(distance)] = np.inf
    k = min(k, distance.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, column = np.nonzero((distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(distance))
    order = np.lexsort((ids[column], distance[row, column], row))
    row, column = row[order], column[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    kept = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
    return row[kept], column[kept]


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10, same: str | None = None, block: int = 50_000, query_block: int = 32_768) -> DataFrame:
    """(query_id, vec_id, distance, rank): exact nearest rows by cosine distance, in blocks of vectors and of queries.

    ``same`` names a column that query and row must share (a filter before the search). Each pair of blocks
    multiplies matrices in one task and keeps its ``k`` best rows a query; a query finds itself.
    """
    n, m = vectors.count(), queries.count()
    parts, query_parts = max(1, -(-n // block)), max(1, -(-m // query_block))
    kind = F.col(same).cast("string") if same else F.lit("")
    held = vectors.select(F.col("vec_id").alias("id"), "embedding", kind.alias("kind"), F.lit(False).alias("is_query"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part"))
    asked = queries.select(F.col("vec_id").alias("id"), "embedding", kind.alias("kind"), F.lit(True).alias("is_query"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(query_parts)).cast("int").alias("query_part"))

    def meet(group: pa.Table) -> pa.Table:
        is_query, ids = group["is_query"].to_numpy(), group["id"].to_numpy()
        unit = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        kinds = np.array(group["kind"].to_pylist())
        q, v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out = [[], [], []]
        for start in range(0, len(q) if len(v) else 0, 256):
            some = q[start : start + 256]
            distance = np.round(1 - unit[some] @ unit[v].T, 6) + 0.0  # no negative zero
            distance[kinds[some][:, None] != kinds[v][None, :]] = np.inf
            row, near = nearest_rows(distance, ids[v], k)
            for column, values in zip(out, (ids[some[row]], ids[v[near]], distance[row, near]), strict=True):
                column.append(values)
        columns = [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table([pa.array(x) for x in columns], ["query_id", "vec_id", "distance"])

    found = held.unionByName(asked.select(held.columns)).groupBy("part", "query_part").applyInArrow(meet, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(legs: Sequence[DataFrame], k: int = 60, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rrf_score, in_first, rank): the sum of 1 / (k + rank) over ranked legs; ``in_first`` for the first leg."""
    every = None
    for i, leg in enumerate(legs):
        own = leg.select("query_id", key, (1 / (k + F.col("rank").cast("double"))).alias("part"), F.lit(i == 0).alias("first"))
        every = own if every is None else every.unionByName(own)
    fused = every.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("rrf_score"), F.max("first").alias("in_first"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), key)
    return fused.withColumn("rank", F.row_number().over(order))


def first_leg_primary(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, in_first, rank): the first leg's order, then what only the second has."""
    both = first.select("query_id", key, F.col("rank").alias("a")).join(second.select("query_id", key, F.col("rank").alias("b")), ["query_id", key], "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.col("a").isNull(), F.coalesce("a", "b"), key)
    return both.select("query_id", key, F.col("a").isNotNull().alias("in_first"), F.row_number().over(order).alias("rank"))


def boost_entity(score: Column, degree: Column, factor: float = 0.2, most: float = 2.0) -> Column:
    """Larger by the logarithm of how often an entity is mentioned."""
    return score * F.least(F.lit(most), 1 + factor * F.log(1 + F.coalesce(degree, F.lit(0)).cast("double")))


def boost_path(score: Column, path: Column, pattern: str, factor: float = 1.4) -> Column:
    return F.when(path.rlike(pattern), score * factor).otherwise(score)


def boost_date_path(score: Column, path: Column, query: Column, as_of: Column, factor: float = 1.35, days: int = 90) -> Column:
    """A date or month that the query names, or with "recent" one of the last ``days``, in the path."""
    day, month = F.regexp_extract(query, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(query, r"(\d{4}-\d{2})", 1)
    own = F.try_to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    fresh = query.rlike(r"(?i)\brecent") & own.between(F.date_sub(as_of, days), as_of)
    hit = F.when(month != "", F.contains(path, F.when(day != "", day).otherwise(month)) | F.contains(path, month)).otherwise(F.coalesce(fresh, F.lit(False)))
    return F.when(hit, score * factor).otherwise(score)


def boost_chunk_date(score: Column, day: Column, asked: Column, half_life: float = 30.0) -> Column:
    """Up to twice as large for a chunk of the asked date, by a bell curve; unchanged without a date."""
    sigma = half_life / 1.177
    apart = F.datediff(day, asked).cast("double")
    return F.when(day.isNull() | asked.isNull(), score).otherwise(score * (1 + F.exp(-(apart * apart) / (2 * sigma * sigma))))


def rerank(ranked: DataFrame, score: Column, most: int = 20, by: str = "query_id") -> DataFrame:
    """The first ``most`` rows by a new score, then the rest as they were; ``old_rank`` is kept."""
    again = F.col("rank") <= most
    scored = ranked.withColumn("rerank_score", F.when(again, score))
    order = Window.partitionBy(by).orderBy((~again).cast("int"), F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order)).withColumnRenamed("rank", "old_rank")


def overlap(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(tokens(query)), F.array_distinct(tokens(text))))


def within_budget(ranked: DataFrame, size: str, budget: int | Column, by: str = "query_id") -> DataFrame:
    """Rows whose sizes, added up in order of rank, stay within the budget; ``used`` is the sum so far."""
    order = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(order)).where(F.col("used") <= budget)


def tier(budget: Column, text: Column, short: Column, medium: Column) -> Column:
    """(tier, content): the short summary up to 150 tokens, the medium one up to 600, else the text; four characters a token."""
    cut = lambda n: F.left(text, (F.lit(n) * 4).cast("int"))
    filled = lambda c: F.nullif(c, F.lit(""))
    return (
        F.when(budget <= 150, F.struct(F.lit("L0").alias("tier"), F.coalesce(filled(short), cut(150)).alias("content")))
        .when(budget <= 600, F.struct(F.lit("L1").alias("tier"), F.coalesce(filled(medium), filled(short), cut(600)).alias("content")))
        .otherwise(F.struct(F.lit("full").alias("tier"), F.left(text, (budget * 4).cast("int")).alias("content")))
    )


def usable_context(ranked: DataFrame, snippet: str, most: int = 5, least: int = 40) -> DataFrame:
    """Of the first rows, those with a snippet long enough."""
    return ranked.where((F.col("rank") <= most) & (F.length(F.btrim(snippet)) >= least))


def normalised_query(text: Column) -> Column:
    return F.array_join(split_words(F.lower(text)), " ")
