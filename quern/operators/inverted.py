"""A stored inverted index: postings in blocks of one term and one shard of documents, written once; a search passes over blocks that can't change its result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS, tokens
from quern.operators.ranking import K1, LEAST_IDF, B, top
from quern.shared import cut, new_path, spread, stored

#: Documents of a shard are at most two to this power; a block holds one term's postings in one shard.
SHARD_BITS = 10
#: Directories that blocks are spread over by the hash of their term.
BUCKETS = 16
#: Shards that a query scores first, those of the largest bounds, to learn what its k-th score is at least.
LEAD = 2
#: Queries that one task scores in a shard at most.
QUERY_BLOCK = 4_096
_STOP = frozenset(STOP_WORDS)
BLOCK = "term string, shard long, n int, total long, top_tf int, low_dl int, docs array<long>, tfs array<int>, dls array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each shard; rows (shard, doc_id, words) come shard after shard."""
    shard, held = None, []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows["words"].combine_chunks()
        ids = rows["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        spelled = lists.flatten().dictionary_encode()
        words = spelled.dictionary.to_pylist()
        counted = np.array([len(x) >= 2 and x not in _STOP for x in words], bool)
        doc = np.repeat(place, pc.fill_null(lists.value_lengths(), 0).to_numpy())
        term = spelled.indices.to_numpy().astype(np.int64)
        keep = counted[term] if len(words) else np.zeros(0, bool)
        doc, term = doc[keep], term[keep]
        sizes = np.bincount(doc, minlength=len(ids))
        pairs, tf = np.unique(term * len(ids) + doc, return_counts=True)
        term, doc = pairs // len(ids), pairs % len(ids)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        bounds = pa.array(np.append(first, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids[order][doc], tf.astype(np.int32), sizes[doc].astype(np.int32))]
        reduced = lambda f, x, t: pa.array(f(x, first).astype(t) if len(first) else np.zeros(0, t))
        columns = [
            pa.array([words[k] for k in term[first].tolist()], pa.string()), pa.array(np.full(len(first), shard, np.int64)),
            reduced(np.add.reduceat, np.ones(len(term), np.int64), np.int32), reduced(np.add.reduceat, tf, np.int64),
            reduced(np.maximum.reduceat, tf, np.int32), reduced(np.minimum.reduceat, sizes[doc], np.int32), *lists,
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "shard", "n", "total", "top_tf", "low_dl", "docs", "tfs", "dls"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        starts = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(shards)], strict=True):
            if held and shards[a] != shard:
                yield block()
                held = []
            shard = int(shards[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield block()


def build_index(docs: DataFrame, cluster: list[str] | None = None, keep: dict[str, Column] | None = None, buckets: int = BUCKETS, bits: int = SHARD_BITS) -> Index:
    """Write the index of ``docs`` (doc_id, text), one row an id, to the shared folder.

    Documents are ranged by ``cluster`` and doc_id, so that those alike share shards and the words of others are in no block of
    theirs. A block is (term, shard), how many documents hold the term, the largest count and the smallest size among them, and
    the postings by doc_id. Blocks are ranged by bucket, term and shard, so that a term of all documents is written
    by many tasks. ``keep`` names what a second table holds of each document. A null text has no words; a document
    without any counts as one.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "index")
    order = [*(cluster or []), "doc_id"]
    n = docs.count()
    parts = max(-(-n // (4 << bits)), min(-(-n // (1 << bits)), spark.sparkContext.defaultParallelism), 1)
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    ranged = docs.select(*dict.fromkeys([*order, "text"])).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits are the partition's number, the lower ones count its rows
    sharded = ranged.select(F.shiftright(F.monotonically_increasing_id(), bits).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("words"))
    blocks = sharded.mapInArrow(_blocks, BLOCK).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    blocks = cut(blocks)
    blocks.repartitionByRange("bucket", "term", "shard").sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.schema(f"{BLOCK}, bucket int").parquet(f"{path}/blocks")
    stored.groupBy("term", "bucket").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spread(docs).select("doc_id", *[c.alias(name) for name, c in (keep or {}).items()]).write.parquet(f"{path}/docs")
    stored.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total")).withColumn("n", F.lit(n)).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/meta")
    return Index(spark, path)


class Index:
    """A written index. What it tells of itself: ``n`` documents of ``mean`` words, ``blocks``, ``terms`` with their frequency, ``docs``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.n, self.buckets = meta.n, meta.buckets
        self.mean = float((meta.total / meta.n if meta.n else 0) or 1.0)
        self.blocks = spark.read.schema(f"{BLOCK}, bucket int").parquet(f"{path}/blocks")
        self.terms = spark.read.schema("term string, bucket int, df long").parquet(f"{path}/terms")
        self.docs = spark.read.parquet(f"{path}/docs")

    def impact(self, tf: Column, dl: Column) -> Column:
        """What a term's frequency in a document adds to its score, but for the term's rarity."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.mean))

    def _wanted(self, queries: DataFrame, prefix: bool) -> DataFrame:
        """(query_id, asked, term, bucket, idf): the index's terms that each query asks for."""
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked"))
        if prefix:
            begins = F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.left(F.col("term"), k))
            known = self.terms.select("*", F.explode(begins).alias("asked"))
        else:
            known = self.terms.withColumn("asked", F.col("term"))
        idf = F.greatest(F.lit(LEAST_IDF), F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        return cut(known.join(asked, "asked").select("query_id", "asked", "term", "bucket", idf.alias("idf")))

    def _bounds(self, wanted: DataFrame, queries: DataFrame, every_term: bool) -> tuple[DataFrame, DataFrame]:
        """What stands in the head of each block asked for, and the most that a shard's documents can score in each query."""
        heads = cut(self.blocks.select("bucket", "term", "shard", "n", "top_tf", "low_dl").join(wanted.select("bucket", "term").distinct(), ["bucket", "term"]))
        most = F.col("idf") * self.impact(F.col("top_tf"), F.col("low_dl"))
        met = heads.join(wanted, ["bucket", "term"]).groupBy("query_id", "shard").agg(F.sum(most).alias("most"), F.countDistinct("asked").alias("_met"), F.sum("n").alias("n"))
        if every_term:
            asked = queries.select("query_id", F.size(F.array_distinct(tokens(F.col("text")))).alias("_asked"))
            met = met.join(asked, "query_id").where(F.col("_met") == F.col("_asked"))
        return heads, cut(met.select("query_id", "shard", "most", "n"))

    def _scored(self, pairs: DataFrame, heads: DataFrame, wanted: DataFrame, parts: int, k: int | None, asked: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, score) of the best documents of each pair (query_id, shard): a shard is scored by one task a block of queries."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
        rows = pairs.join(wanted, "query_id").join(heads.select("bucket", "term", "shard"), ["bucket", "term", "shard"])
        rows = rows.select("shard", part, "query_id", "asked", "term", "bucket", "idf")
        rows = rows.join(asked, "query_id") if asked is not None else rows.withColumn("_asked", F.lit(0))
        asked_for = rows.select("bucket", "term", "shard", "part").distinct()
        needed = self.blocks.select("bucket", "term", "shard", "docs", "tfs", "dls").join(asked_for, ["bucket", "term", "shard"])
        needed = needed.select(F.col("shard").alias("of_shard"), F.col("part").alias("of_part"), "term", "docs", "tfs", "dls")
        mean = self.mean

        def score(blocks: pa.Table, queries: pa.Table) -> pa.Table:
            at = {t: i for i, t in enumerate(blocks["term"].to_pylist())}
            lists = blocks["docs"].combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            ids, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            tf, dl = (blocks[c].combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "dls"))
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            queries = queries.sort_by([("query_id", "ascending"), ("asked", "ascending"), ("term", "ascending")])
            ask, terms, words = queries["query_id"].to_numpy(), queries["term"].to_pylist(), queries["asked"].to_pylist()
            idf, least = queries["idf"].to_numpy(), queries["_asked"].to_numpy()
            out = [[], [], []]
            starts = np.flatnonzero(np.diff(ask, prepend=ask[:1] - 1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(ask)], strict=True):
                total, met = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                hit, last = np.zeros(len(ids), bool), None
                for r in range(a, b):
                    s = slice(bounds[at[terms[r]]], bounds[at[terms[r]] + 1])
                    if words[r] != last:
                        met += hit
                        hit[:] = False
                        last = words[r]
                    total[place[s]] += idf[r] * impact[s]  # a document stands once in a block
                    hit[place[s]] = True
                met += hit
                found = np.flatnonzero(met >= max(1, least[a]))
                score = np.round(total[found], 6)
                if k is not None and len(found) > k:
                    best = np.lexsort((ids[found], -score))[:k]
                    found, score = found[best], score[best]
                out[0].append(np.full(len(found), ask[a]))
                out[1].append(ids[found])
                out[2].append(score)
            columns = [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
            return pa.table([pa.array(x) for x in columns], ["query_id", "doc_id", "score"])

        return needed.groupBy("of_shard", "of_part").cogroup(rows.groupBy("shard", "part")).applyInArrow(score, "query_id long, doc_id long, score double")

    def _searched(self, queries: DataFrame, k: int | None, every_term: bool, prefix: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The bounds of all pairs of query and shard, those that were scored, and the scores."""
        parts = max(1, -(-queries.count() // QUERY_BLOCK))
        wanted = self._wanted(queries, prefix)
        heads, bounds = self._bounds(wanted, queries, every_term)
        asked = queries.select("query_id", F.size(F.array_distinct(tokens(F.col("text")))).alias("_asked")) if every_term else None
        score = lambda pairs: self._scored(pairs.select("query_id", "shard"), heads, wanted, parts, k, asked)
        if k is None:
            return bounds, bounds, score(bounds)
        lead = top(bounds, LEAD, "most", "shard").drop("rank")
        led = cut(score(lead))
        least = top(led, k, "score", "doc_id").where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        # bounds and scores are sums in another order; the smallest difference of scores is allowed for
        left = bounds.join(lead.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(least, "query_id", "left")
        left = left.where(F.col("_least").isNull() | (F.col("most") >= F.col("_least") - 2e-6)).drop("_least")
        return bounds, lead.unionByName(left), led.unionByName(score(left))

    def search(self, queries: DataFrame, k: int | None = 10, every_term: bool = False, prefix: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank): the best documents of ``queries`` (query_id, text) by BM25, ties to smaller ids.

        A document matches with any term, or with ``every_term``; with ``prefix`` a term stands for all that begin with it. From the
        heads of the blocks comes the most that any document of a shard can score. A query scores its ``LEAD`` shards of
        the largest bounds, and then those only whose bound reaches the k-th score found there: no other can hold a better
        document. Without ``k`` all matches are scored, and there is no rank.
        """
        scored = self._searched(queries, k, every_term, prefix)[2]
        return top(scored, k, "score", "doc_id") if k is not None else scored

    def postings_read(self, queries: DataFrame, k: int = 10, every_term: bool = False, prefix: bool = False) -> DataFrame:
        """(query_id, shards, shards_read, postings, postings_read): what the index holds of each query's terms, and what its search read."""
        bounds, read, _ = self._searched(queries, k, every_term, prefix)
        part = read.groupBy("query_id").agg(F.count("*").alias("shards_read"), F.sum("n").alias("postings_read"))
        return bounds.groupBy("query_id").agg(F.count("*").alias("shards"), F.sum("n").alias("postings")).join(part, "query_id")


def stored_index(docs: DataFrame, name: str, cluster: list[str] | None = None, keep: dict[str, Column] | None = None) -> Index:
    """The index of ``docs`` that the shared folder holds, or a new one where its files have changed since, or ``name`` is new."""
    return Index(docs.sparkSession, stored(docs, repr((name, cluster, sorted(keep or {}))), lambda: build_index(docs, cluster, keep).path))
