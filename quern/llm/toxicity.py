"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.mixing import place
from quern.llm.shared import whole
from quern.llm.words import hashes, mixed, slices, spans

#: The hashed feature space; the model keeps the features whose weight L1 leaves.
BITS = 22
#: The bound of the training sample: labelled rows.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Bytes of words (ASCII letters and digits, and all of UTF-8 beyond ASCII), and the lower case of each byte.
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) arrays of words, pairs of words, and pairs with one word between."""
    data = _LOWER[data]
    starts, ends, first = spans(data, at, _WORD)
    h = hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    shift, odd = np.uint64(64 - BITS), np.uint64(0xD6E8FEB86659FD93)
    yield row, (h >> shift).astype(np.int64)
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = mixed(h[:-gap] * odd + h[gap:] + np.uint64(gap))
            yield row[gap:][same], (pair[same] >> shift).astype(np.int64)


def train(
    rows: list[tuple[np.ndarray, int]], alpha: float = 5.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, epochs: int = 4
) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights). A row is its present features and its label; each feature has its own rate."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(n[f])) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for f, label in rows:
            w = weights(f)
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - label
            grown = np.sqrt(n[f] + g * g)
            z[f] += g - (grown - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    found = np.flatnonzero(np.abs(z) > l1)
    return bias, found, weights(found)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Learn from at most ``most`` labelled rows that aren't held out, those with the smallest hash of doc_id.

    Several labels of one doc_id count as their largest, null labels as none. One task streams the sample; what the
    driver gets are the weights that L1 leaves, fewer than 2^22.
    """
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_place", place(F.col("doc_id"))).orderBy("_place", "doc_id").limit(most)
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .select("_place", "doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for i, j, data, at in slices(batch.column("text")):
                found = list(features(data, at))
                row, f = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                pairs = np.unique(row << BITS | f)
                cuts = np.searchsorted(pairs >> BITS, np.arange(j - i + 1))
                own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                rows += [(own[cuts[k] : cuts[k + 1]], toxic[i + k]) for k in range(j - i)]
        bias, f, w = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([f.tolist()]), pa.array([w.tolist()])], ["bias", "f", "w"])

    one = texts.repartition(1).sortWithinPartitions("_place", "doc_id", "text")
    got = one.mapInArrow(learn, "bias double, f array<long>, w array<double>").first()
    if got is None:  # no labelled rows, no task
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    return got["bias"], np.array(got["f"], np.int64), np.array(got["w"], float)


def toxicity(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], name: str = "toxicity") -> DataFrame:
    """``docs`` and the model's score of the whole text, between 0 and 1.

    A null or empty text gets the score that the bias alone gives; repeated rows score alike; an existing column of
    that name is replaced; an empty table gives an empty table. Features count once a text, so that length doesn't.
    """
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, f, w = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[f] = w
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for i, j, data, at in slices(batch.column("text")):
                hits = [row[k] << BITS | g[k] for row, g in features(data, at) for k in [np.flatnonzero(dense[g])]]
                pairs = np.unique(np.concatenate(hits))
                np.add.at(out, i + (pairs >> BITS), dense[pairs & ((1 << BITS) - 1)])
            scores = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return docs.mapInArrow(score, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs.withColumn("text", whole(F.col("text"))), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
