"""Dated chunks of notes, stored by day, and searches inside the time that a query names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import exploded_tokens, tokens
from quern.operators.corpus import query_window
from quern.operators.ranking import K1, LEAST_IDF, B, top
from quern.shared import cut

CARD = r"(?m)^\s*[-*] (?:\[.\] )?(\S.*)$"
DAY = r"(\d{4}-\d{2}-\d{2})"
#: What a query says of its time; the rest is what is searched for.
TIME_WORDS = r"(?i)\b(?:(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}|\d{4}-\d{2}(?:-\d{2})?|last (?:week|month)|yesterday|today)\b"


def dated_chunks(notes: DataFrame) -> DataFrame:
    """(path, seq, chunk_type, title, text, chunk_date) of ``notes`` (path, text): sections of memory logs and cards of boards.

    A memory log is named by its day and has sections under ``##`` headings; what stands before the first is none. In any other note a list
    item with a day is a card. Undated notes and items have no chunk.
    """
    day = F.try_to_date(F.regexp_extract("path", rf"(?:^|/)memory/{DAY}[^/]*\.md$", 1), "yyyy-MM-dd")
    logs = notes.select("path", "text", day.alias("chunk_date")).where("chunk_date IS NOT NULL")
    part = F.split(F.concat(F.lit("\n"), "text"), r"\r?\n## ")
    sections = logs.select("path", "chunk_date", F.posexplode(F.slice(part, F.lit(2), F.size(part))).alias("seq", "_s"))
    sections = sections.select("path", "seq", F.lit("memory_section").alias("chunk_type"), F.btrim(F.substring_index("_s", "\n", 1), F.lit(" \r")).alias("title"), F.col("_s").alias("text"), "chunk_date")
    boards = notes.where(~F.rlike("path", F.lit(rf"(?:^|/)memory/{DAY}[^/]*\.md$"))).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(CARD), F.lit(1))).alias("seq", "_s"))
    cards = boards.select("path", "seq", F.lit("board_card").alias("chunk_type"), F.btrim(F.regexp_replace("_s", rf"@?\{{?{DAY}\}}?", "")).alias("title"), F.col("_s").alias("text"), F.try_to_date(F.regexp_extract("_s", DAY, 1), "yyyy-MM-dd").alias("chunk_date"))
    return sections.unionByName(cards.where("chunk_date IS NOT NULL"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks in a folder a day; a day of many chunks is written by many tasks."""
    chunks.repartitionByRange("chunk_date", *[c for c in ("path", "seq") if c in chunks.columns]).write.mode("overwrite").partitionBy("chunk_date").parquet(path)


def asked_for(text: Column) -> Column:
    """A query without what it says of its time."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, TIME_WORDS, " "), r"\s+", " "))


def timeline(queries: DataFrame, chunks: DataFrame, fallback: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank, fell_back): the best chunks of each query's time by BM25 among that time's chunks, ties to smaller ids.

    ``queries`` are (query_id, text, as_of), ``chunks`` (chunk_id, text, chunk_date), of which only the days between the first and the last
    that any query names are read, if each names some; then a query's days meet their chunks by equality. A query that names no
    time is for all chunks. Queries that find nothing have the rows of ``fallback`` (query_id, doc_id, score, rank) instead.
    """
    window = query_window(F.col("text"), F.col("as_of"))
    timed = cut(queries.select("query_id", asked_for(F.col("text")).alias("text"), window.alias("_w")).select("query_id", "text", F.col("_w.start").alias("start"), F.col("_w.end").alias("end")))
    first, last, timeless = timed.agg(F.min("start"), F.max("end"), F.count(F.when(F.col("start").isNull(), 1))).first()
    spans = timed.select("start", "end").distinct()
    near = chunks if timeless else chunks.where(F.col("chunk_date").between(F.lit(first), F.lit(last)))
    days = spans.where("start IS NOT NULL").select("start", "end", F.explode(F.sequence("start", "end")).alias("chunk_date")).where("chunk_date <= end")
    words = exploded_tokens(near.select("chunk_id", "chunk_date", "text"))
    counted = cut(words.groupBy("chunk_id", "chunk_date", "term").agg(F.count("*").alias("tf")))
    sizes = near.select("chunk_id", "chunk_date").join(counted.groupBy("chunk_id").agg(F.sum("tf").alias("dl")), "chunk_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    always = timed.where("start IS NULL").select("start", "end").limit(1)  # one span for all that name no time
    within = sizes.join(days, "chunk_date").select("start", "end", "chunk_id", "dl")
    if timeless:
        within = within.unionByName(sizes.crossJoin(F.broadcast(always)).select("start", "end", "chunk_id", "dl"))
    within = within.select(F.coalesce(F.col("start").cast("string"), F.lit("")).alias("start"), F.coalesce(F.col("end").cast("string"), F.lit("")).alias("end"), "chunk_id", "dl")
    of_span = within.groupBy("start", "end").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    asked = timed.select("query_id", F.coalesce(F.col("start").cast("string"), F.lit("")).alias("start"), F.coalesce(F.col("end").cast("string"), F.lit("")).alias("end"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = asked.select("start", "end", "term").distinct()
    tf = within.join(counted.select("chunk_id", "term", "tf"), "chunk_id").join(wanted, ["start", "end", "term"])
    df = tf.groupBy("start", "end", "term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = tf.join(df, ["start", "end", "term"]).join(of_span, ["start", "end"]).select("start", "end", "term", "chunk_id", weight.alias("w"))
    found = scored.join(asked, ["start", "end", "term"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))
    best = top(found, k, "score", "chunk_id").withColumn("fell_back", F.lit(False))
    if fallback is None:
        return best
    best = cut(best)
    other = fallback.join(timed.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank", F.lit(True).alias("fell_back"))
    return best.unionByName(other.join(best.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k))
