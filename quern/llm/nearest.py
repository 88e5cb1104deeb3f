"""Approximate nearest neighbours: shifted Hilbert orderings of projected vectors, neighbouring key windows, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.curves import hilbert_keys
from quern.llm.mixing import place
from quern.llm.shared import cut
from quern.llm.words import mixed

#: Orderings, projected dimensions, bits of each, and bits that deal vectors of one cell over the places it spans.
CURVES, DIMS, BITS, TIE_BITS = 16, 6, 8, 14
#: Bounds of what is fitted on: vectors for the projections, queries for the windows.
SAMPLE_VECTORS, SAMPLE_QUERIES = 20_000, 64
#: The recall that windows are widened to on the sampled queries; others find a little less.
RECALL = 0.93
#: Vectors of a block at least (about), blocks of an ordering at most, and sampled keys a block is cut by.
BLOCK, MOST_BLOCKS, KEYS_A_BLOCK = 16_384, 50_000, 16
#: So many times the neighbours asked for are reranked by exact distances.
RERANKED = 4


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


@dataclass
class Curves:
    """Projections and shifts of each ordering, from a sample of vectors."""

    center: np.ndarray
    projections: np.ndarray
    low: np.ndarray
    width: np.ndarray
    shifts: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, seed: int = 7) -> Curves:
        rng = np.random.default_rng(seed)
        n = sample.shape[1]
        projections = np.stack([np.linalg.qr(rng.normal(size=(n, n)))[0][:, : min(DIMS, n)] for _ in range(CURVES)])
        center = sample.mean(axis=0)
        placed = (sample - center) @ projections
        low, high = np.quantile(placed, 0.001, axis=1), np.quantile(placed, 0.999, axis=1)
        width = np.maximum((high - low).max(axis=1, keepdims=True), 1e-12)
        return cls(center, projections, low, width, rng.uniform(0, 0.5, low.shape))

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(curves, vectors): places on each curve; ``ids`` deal vectors of one cell."""
        out = np.zeros((CURVES, len(vectors)), np.int64)
        for m in range(CURVES):
            unit = ((vectors - self.center) @ self.projections[m] - self.low[m]) / (2 * self.width[m]) + self.shifts[m]
            cells = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            tie = (mixed(ids.astype(np.uint64) + np.uint64(m + 1)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            out[m] = hilbert_keys(cells, BITS) << TIE_BITS | tie
        return out


def coded(vectors: np.ndarray) -> pa.Array:
    """Each vector as bytes: a scale, then a byte a component; rough, but a fraction as wide as the vector."""
    scale = (np.abs(vectors).max(axis=1) / 127).astype("<f8")
    scale[scale == 0] = 1
    parts = np.rint(vectors / scale[:, None]).clip(-127, 127).astype(np.int8)
    return pa.array([x.tobytes() for x in np.concatenate([scale.view(np.int8).reshape(len(vectors), 8), parts], axis=1)], pa.binary())


def decoded(codes: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return data[:, 8:] * np.ascontiguousarray(data[:, :8]).view("<f8")


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def closest(queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances): the ``k`` nearest vectors, and all as near as the last, by exact distances."""
    norms = (vectors**2).sum(axis=1)
    for start in range(0, len(queries), 256):
        some = queries[start : start + 256]
        rough = norms[None, :] - 2 * some @ vectors.T + (some**2).sum(axis=1)[:, None]
        kth = np.partition(rough, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
        slack = 1e-9 * (norms.max() + (some**2).sum(axis=1))
        for i in range(len(some)):
            near = np.flatnonzero(rough[i] <= kth[i] + slack[i])
            exact = np.sqrt(((vectors[near] - some[i]) ** 2).sum(axis=1))
            yield start + i, near, exact


def _top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pa.Table:
    out = [[], [], []]
    for i, near, exact in closest(queries, vectors, k):
        order = np.lexsort((ids[near], exact))[:k]
        out[0].append(np.full(len(order), query_ids[i]))
        out[1].append(ids[near[order]])
        out[2].append(exact[order])
    kinds = (np.int64, np.int64, np.float64)
    return pa.table([np.concatenate([*x, np.zeros(0, kind)]).astype(kind) for x, kind in zip(out, kinds, strict=True)], ["query_id", "rep", "score"])


def distinct_points(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows that take part, points): equal vectors are one point with its k + 1 smallest ids, all that a result can need."""
    fine = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    if sizes is None:
        return None
    fine = fine.where(F.size("embedding") == sizes["size"]).distinct()
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    points = cut(
        fine.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.element_at("ids", 1))
    )
    return fine, points


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, reach: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each of ``queries`` (rows of ``vectors``).

    Euclidean distance in double precision on the vectors as they are; a query's own row isn't a candidate, equal
    distances go to the smaller id. Unusable vectors, null ids and vectors of another length than most take no part;
    repeated rows of one id and vector count once. Other columns play no part; an empty table gives an empty table.

    Each ordering puts all vectors on a line by key. A query meets the ``reach`` vectors on both sides of its place on
    each. They are compared by one-byte components, the best of all orderings then by exact distances. The reach is, unless
    given, the least that finds RECALL of the exact neighbours of at most SAMPLE_QUERIES queries, which are compared with all
    vectors. Lines are cut into blocks of keys of at least four times the reach, and a query asks the blocks beside its own.
    """
    spark = vectors.sparkSession
    made = distinct_points(vectors, k)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine, points = made
    asked = cut(queries.select(F.col("vec_id").cast("long")).distinct().join(fine, "vec_id"))
    n = points.count()
    sample = points.orderBy(place(F.col("rep")), "rep").limit(SAMPLE_VECTORS).select("embedding").toArrow()
    curves = Curves.fit(matrix(sample["embedding"].combine_chunks()))
    reach = reach or window_reach(points, asked, curves, k)
    bounds = block_bounds(points, curves, n, max(BLOCK, 4 * reach))
    sent = spark.sparkContext.broadcast((curves, bounds))
    row = "curve int, block int, query boolean, id long, key long, code binary"

    def deal(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        """A row for each block in which a vector or a query takes part."""
        placed, edges = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, every = batch.column(0).to_numpy(), matrix(batch.column(1))
            codes, keys = coded(every), placed.keys(every, ids)
            for curve in range(CURVES):
                own = np.searchsorted(edges[curve], keys[curve], "right")
                for step in (-1, 0, 1) if query else (0,):
                    keep = np.flatnonzero((own + step >= 0) & (own + step <= len(edges[curve])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keep), curve, np.int32)), pa.array((own[keep] + step).astype(np.int32)), pa.array(np.full(len(keep), query)),
                         pa.array(ids[keep]), pa.array(keys[curve][keep]), codes.take(pa.array(keep))],
                        ["curve", "block", "query", "id", "key", "code"],
                    )

    def windows(group: pa.Table) -> pa.Table:
        """The best of each query's window in one block, by the rough distances."""
        is_query, key, ids = (group[c].to_numpy() for c in ("query", "key", "id"))
        every = decoded(group["code"])
        order = np.flatnonzero(~is_query)
        order = order[np.lexsort((ids[order], key[order]))]
        line, there, line_ids = key[order], every[order], ids[order]
        norms, most = (there**2).sum(axis=1), RERANKED * (k + 1)
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float64)]]
        for q in np.flatnonzero(is_query).tolist():
            at = int(np.searchsorted(line, key[q]))
            a, b = max(0, at - reach), min(len(line), at + reach + 1)
            rough = norms[a:b] - 2 * (there[a:b] @ every[q])
            near = np.argpartition(rough, most)[:most] if len(rough) > most else np.arange(len(rough))
            out[0].append(np.full(len(near), ids[q]))
            out[1].append(line_ids[a + near])
            out[2].append(rough[near].astype(np.float64))
        return pa.table([np.concatenate(x) for x in out], ["query_id", "rep", "rough"])

    met = (
        points.select("rep", "embedding").mapInArrow(lambda x: deal(x, False), row)
        .unionByName(asked.select("vec_id", "embedding").mapInArrow(lambda x: deal(x, True), row))
        .groupBy("curve", "block").applyInArrow(windows, "query_id long, rep long, rough double")
    )
    roughly = Window.partitionBy("query_id").orderBy("rough", "rep")
    likely = (
        met.groupBy("query_id", "rep").agg(F.min("rough").alias("rough"))
        .withColumn("_n", F.row_number().over(roughly)).where(F.col("_n") <= RERANKED * (k + 1)).select("query_id", "rep")
    )
    apart = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    score = F.sqrt(F.aggregate(F.zip_with("embedding", "_asked", apart), F.lit(0.0), lambda total, x: total + x))
    reranked = (
        likely.join(points, "rep").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_asked")), "query_id")
        .select("query_id", "ids", score.alias("score"))
    )
    by_id = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        reranked.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def block_bounds(points: DataFrame, curves: Curves, n: int, rows: int) -> list[np.ndarray]:
    """The keys that cut each ordering into blocks of about ``rows`` vectors (more, if there were over MOST_BLOCKS)."""
    blocks = min(MOST_BLOCKS, n // rows)
    if blocks < 2:
        return [np.zeros(0, np.int64)] * CURVES

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = curves.keys(matrix(batch.column(1)), batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], [f"c{m}" for m in range(CURVES)])

    sampled = points.where(place(F.col("rep")) % n < KEYS_A_BLOCK * blocks) if KEYS_A_BLOCK * blocks < n else points
    every = sampled.select("rep", "embedding").mapInArrow(keys, ", ".join(f"c{m} long" for m in range(CURVES))).toArrow()
    found = []
    for m in range(CURVES):
        line = np.sort(every[f"c{m}"].to_numpy())
        found.append(line[np.arange(1, blocks) * len(line) // blocks] if len(line) else np.zeros(0, np.int64))
    return found


def exact(points: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(query_id, rep, score): the k + 1 nearest points of a few queries among all ``points``."""
    ids, vectors = asked["vec_id"].to_numpy(), matrix(asked["embedding"].combine_chunks())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _top(vectors, ids, matrix(batch.column(1)), batch.column(0).to_numpy(), k + 1).to_batches()

    best = Window.partitionBy("query_id").orderBy("score", "rep")
    found = points.select("rep", "embedding").mapInArrow(scan, "query_id long, rep long, score double")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")


def window_reach(points: DataFrame, asked: DataFrame, curves: Curves, k: int, recall: float = RECALL) -> int:
    """How far along the nearest of the orderings a window must reach to find ``recall`` of the sampled queries' neighbours.

    Tasks count the vectors between each query and each of its neighbours on every ordering; the driver sums at most
    SAMPLE_QUERIES * (k + 1) * CURVES counts a task.
    """
    some = asked.orderBy(place(F.col("vec_id")), "vec_id").limit(SAMPLE_QUERIES).toArrow()
    if not some.num_rows:
        return 1
    truth = exact(points, some, k).where(F.col("score") > 0).join(points.select("rep", "embedding"), "rep").orderBy("query_id", "rep").toArrow()
    if not truth.num_rows:
        return 1
    theirs = curves.keys(matrix(truth["embedding"].combine_chunks()), truth["rep"].to_numpy())
    row = {x: i for i, x in enumerate(some["vec_id"].to_pylist())}
    own = curves.keys(matrix(some["embedding"].combine_chunks()), some["vec_id"].to_numpy())[:, [row[x] for x in truth["query_id"].to_pylist()]]
    low, high = np.minimum(theirs, own), np.maximum(theirs, own)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(low.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                keys = np.sort(curves.keys(matrix(batch.column(1)), batch.column(0).to_numpy()), axis=1)
                for m in range(CURVES):
                    counts[m] += np.searchsorted(keys[m], high[m], "right") - np.searchsorted(keys[m], low[m], "left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(counts.size)), pa.array(counts.reshape(-1))], ["place", "n"])

    summed = points.select("rep", "embedding").mapInArrow(between, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(low.size, np.int64)
    counts[summed["place"].to_numpy()] = summed["n"].to_numpy()
    gaps = np.sort(counts.reshape(low.shape).min(axis=0))
    return int(gaps[max(0, int(np.ceil(recall * len(gaps))) - 1)])


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
