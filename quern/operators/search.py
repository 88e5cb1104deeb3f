"""What stands around a search: scopes, budgets, cache keys, metadata of hits, context of answers, and embedding runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import small

SCOPES = "shared agent shared+agent all-agents everything".split()


def resolve_scopes(requests: DataFrame, agents: DataFrame, shared: Sequence[str], pattern: str = "{agent}-memory") -> DataFrame:
    """``requests`` (scope, agent) with ``collections``, in order and without repeats; null where nothing is named.

    ``agents`` is (agent, collections): one narrow row an agent. An agent that isn't registered has the collection that the
    pattern names. An empty registry is an error for scopes that need all agents.
    """
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("agent", "collections"))), lambda x: x["collections"]))
    every = agents.agg(F.coalesce(listed, F.array().cast("array<string>")).alias("_every"))  # one row
    wide = requests.where(F.col("scope").isin("all-agents", "everything"))
    if every.where(F.size("_every") == 0).count() and not wide.isEmpty():
        raise ValueError("scopes of all agents need a registry with agents")
    none = F.array().cast("array<string>")
    lists = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else none
    before, after = pattern.split("{agent}")
    joined = requests.join(small(agents.select("agent", F.col("collections").alias("_own"))), "agent", "left").join(F.broadcast(every))
    own = F.when(F.coalesce("agent", F.lit("")) == "", none).otherwise(F.coalesce("_own", F.array(F.concat(F.lit(before), "agent", F.lit(after)))))
    found = (
        F.when(F.col("scope") == "shared", lists(shared)).when(F.col("scope") == "agent", own).when(F.col("scope") == "shared+agent", F.concat(lists(shared), own))
        .when(F.col("scope") == "all-agents", F.col("_every")).when(F.col("scope") == "everything", F.concat(lists(shared), F.col("_every")))
    )
    once = F.array_distinct(found)
    return joined.withColumn("collections", F.when(F.size(once) > 0, once)).drop("_own", "_every")


def budget_of(intent: Column) -> Column:
    """Tokens that an intent asks for: little for a lookup, much for what joins several documents."""
    return F.when(intent.isin("keyword", "entity"), 1500).when(intent == "multi_hop", 5000).otherwise(3000)


def cache_key(query: Column, scope: Column, agent: Column, collections: Column) -> Column:
    """Equal for queries that differ in case, white space and the order of collections only."""
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    parts = (F.array_join(words, " "), F.coalesce(scope, F.lit("")), F.coalesce(agent, F.lit("")), F.array_join(F.sort_array(F.coalesce(collections, F.array().cast("array<string>"))), ","))
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def table_state(df: DataFrame | None) -> str:
    """``missing`` for no table, ``empty`` for one without rows, else ``ok``."""
    return "missing" if df is None else "empty" if df.isEmpty() else "ok"


def needs_rebuild(index: DataFrame, ids: DataFrame, key: str = "doc_id") -> bool:
    """Whether an index lacks any of the ids."""
    return not ids.select(key).join(index.select(key), key, "left_anti").isEmpty()


def resolve_hits(hits: DataFrame, documents: DataFrame, collections: Sequence[str] | None = None) -> DataFrame:
    """Hits (query_id, hash, rank) with their documents' columns in one join; inactive ones and other collections go, ranks stay."""
    live = documents.where(F.col("active") == 1)
    if collections:
        live = live.where(F.col("collection").isin(list(collections)))
    return hits.join(live, "hash")


def merged_paths(ranked: DataFrame, prefix: str) -> DataFrame:
    """``ranked`` (query_id, path, rank) with one row of a document that has a path under ``prefix`` and without; ranks closed up."""
    bare = F.regexp_replace("path", f"^{prefix}/", "")
    once = ranked.groupBy("query_id", bare.alias("path")).agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path")))


def context(ranked: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """(query_id, context): titles and starts of the first documents of a query, in order of rank."""
    part = F.concat(F.lit("["), F.col("title"), F.lit("]\n"), F.left("text", F.lit(chars)))
    first = ranked.where(F.col("rank") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return first.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("context"))


def trimmed(sources: DataFrame, most: int, by: str) -> DataFrame:
    """Sources (by, priority, tokens) within ``most`` tokens: the most important first, the one that passes the bound is cut to it."""
    before = Window.partitionBy(by).orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return sources.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("tokens"), F.lit(most) - used))).where(F.col("kept") > 0)


def offline_vector(text: str, dims: int) -> list[float]:
    """A unit vector that only the text decides, for runs without a provider."""
    import hashlib

    raw = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)[:dims].astype(float) - 127.5
    return (raw / np.linalg.norm(raw)).tolist()


def embedded(texts: list[str], provider: Callable[[list[str]], list[list[float]]]) -> list[list[float] | None]:
    """Vectors of texts; a batch that fails is halved until single texts fail, which have none."""
    try:
        found = provider(texts)
        if len(found) != len(texts):
            raise ValueError("fewer vectors than texts")
        return list(found)
    except Exception:  # a provider may raise anything
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return embedded(texts[:half], provider) + embedded(texts[half:], provider)


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dims: int, batch: int = 64) -> DataFrame:
    """``chunks`` (…, text) with ``embedding``, null where the provider failed, and ``failed``; a vector of another length is an error."""
    from pyspark.sql import types as T

    names = chunks.columns
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("failed", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch):
                vectors += embedded([x or "" for x in frame["text"].iloc[at : at + batch]], provider)
            if any(v is not None and len(v) != dims for v in vectors):
                raise ValueError(f"the provider's vectors don't have {dims} components")
            out = frame[names].copy()
            out["embedding"], out["failed"] = vectors, [v is None for v in vectors]
            yield out

    return chunks.mapInPandas(run, schema)


def embed_report(done: DataFrame) -> DataFrame:
    """(embedded, failed) counts of a run."""
    return done.agg(F.count_if(~F.col("failed")).alias("embedded"), F.count_if("failed").alias("failed"))


def topic_sections(text: Column, topic: Column) -> Column:
    """Sections of level 2 and 3 whose heading holds the topic, else up to 30 lines that do, else the first 2000 characters."""
    low = F.lower(topic)
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{2,3} )")  # what stands before the first heading is the first
    sections = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda s: F.contains(F.lower(F.substring_index(s, "\n", 1)), low))
    hits = F.slice(F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), low)), 1, 30)
    return F.when(F.size(sections) > 0, F.array_join(sections, "\n\n")).when(F.size(hits) > 0, F.array_join(hits, "\n")).otherwise(F.left(text, F.lit(2000)))


def confidence(answer: Column) -> Column:
    """The confidence that an answer states, as JSON or in words, per cent too, between 0 and 1; null if it states none."""
    json = F.when(F.btrim(answer).rlike(r"^\{(?s:.*)\}$"), F.get_json_object(answer, "$.confidence"))
    strict = F.when(F.btrim(answer).rlike(r"(?s)\"confidence\"\s*:\s*-?[0-9]"), json.try_cast("double"))
    pattern = r"(?i)[\"']?confidence[\"']?\s*(?:[:=]|\bis\b)\s*(-?\d+(?:\.\d+)?)\s*(%)?"
    value = F.regexp_extract(answer, pattern, 1).try_cast("double")
    said = F.when(F.regexp_extract(answer, pattern, 2) == "%", value / 100).otherwise(value)
    found = F.coalesce(strict, said)
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def split_at_headings(text: Column, stem: Column, most: int = 50_000, least: int = 500) -> Column:
    """(stem, text) parts of a long text, cut before headings of level 1 and 2; a short text, or one part, keeps its stem.

    What stands before the first heading is a part of its own if it has ``least`` bytes.
    """
    parts = F.transform(F.split(text, r"(?m)(?=^#{1,2}[ \t]+\S)"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    bytes_ = lambda c: F.octet_length(F.encode(c, "utf-8"))
    kept = F.filter(parts, lambda p: (p != "") & (p.rlike(r"^#{1,2}[ \t]+\S") | (bytes_(p) >= least)))
    slug = lambda h: F.left(F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(h), r"[^a-z0-9\s-]", ""), r"[\s_]+", "-"), "-{2,}", "-"), F.lit("-")), F.lit(60))
    heading = lambda p: F.when(p.rlike(r"^#{1,2}[ \t]+\S"), slug(F.regexp_extract(p, r"^#{1,2}[ \t]+([^\n]*)", 1))).otherwise(F.lit("preamble"))
    part = lambda s, t: F.struct(s.alias("stem"), t.alias("text"))
    named = F.transform(kept, lambda p, i: part(F.left(F.concat(stem, F.lit("-part-"), F.format_string("%02d", i + 1), F.lit("-"), heading(p)), F.lit(100)), p))
    whole = F.array(part(stem, text))
    has_heading = text.rlike(r"(?m)^#{1,2}[ \t]+\S")
    return F.when((bytes_(text) <= most) | ~has_heading | (F.size(kept) == 0), whole).when(F.size(kept) == 1, F.array(part(stem, F.element_at(kept, 1)))).otherwise(named)


def deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(category, delta): a second run's category means less the first one's, to four places."""
    both = baseline.select("category", F.col("mean").alias("_a")).join(current.select("category", F.col("mean").alias("_b")), "category", "full_outer")
    return both.select("category", F.round(F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0)), 4).alias("delta"))


def recommended(counts: DataFrame) -> DataFrame:
    """Settings that a corpus asks for, from its shares of dated, procedural, entity and pdf files."""
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    keep = [c for c in counts.columns if c not in ("total", "dated", "procedural", "entities", "pdf")]
    return counts.select(
        *keep, (share("dated") > 0.15).alias("temporal_boost"), (share("procedural") > 0.05).alias("procedural_boost"), (share("entities") > 0.03).alias("entity_boost"),
        F.when(share("pdf") > 0.20, "rrf").otherwise("bm25_primary").alias("fusion_strategy"),
    )
