"""Toxicity: held-out accuracy, what is learned from, and a plain Python trainer."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm.toxicity import BITS, THRESHOLD, features, fit, op10_toxicity, toxicity, train
from quern.llm.words import slices


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op10_tells_held_out_documents(spark, sf_dir):
    """Of ten held-out documents labelled toxic about two hold no toxic word: labels are noisy."""
    sf_dir = sf_dir.replace("0.01", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [p for p, y in seen if y == 1], [p for p, y in seen if y == 0]
    assert len(toxic) > 50 and sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def test_only_text_and_learning_rows_count(spark, sf_dir):
    """Scores don't follow held-out labels, or other columns."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = fit(docs, labels)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = fit(docs.withColumn("lang", F.lit("xx")), labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert model[0] == flipped[0] and (model[1] == flipped[1]).all() and (model[2] == flipped[2]).all()
    other = fit(docs, labels.withColumn("toxic", 1 - F.col("toxic")))
    assert len(other[1]) != len(model[1]) or (other[2] != model[2]).any()


def plain_train(rows, alpha=5.0, beta=1.0, l1=5.0, l2=0.1, epochs=4):
    """FTRL-proximal, a feature at a time."""
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for f, label in rows:
            w = {i: weight(i) for i in f.tolist()}
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - label
            for i, wi in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * wi
                n[i] = before + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    return bias, {i: weight(i) for i in z if abs(z[i]) > l1}


def test_training_equals_plain_python():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 60, 12)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(300)]
    rows = [(np.append(f, 99).astype(np.int32) if y else f, y) for f, y in rows]
    bias, found, weights = train(rows)
    plain_bias, plain = plain_train(rows)
    assert bias == pytest.approx(plain_bias) and found.tolist() == sorted(plain)
    assert weights == pytest.approx([plain[i] for i in found.tolist()])
    assert 99 in found.tolist()


def test_features_are_words_pairs_and_pairs_over_one():
    (_, _, data, at), = slices(pa.array(["One two, three two", "", "ONE"]))
    found = [set(zip(row.tolist(), f.tolist(), strict=True)) for row, f in features(data, at)]
    assert [len(x) for x in found] == [4, 3, 2]
    assert {f for r, f in found[0] if r == 2} < {f for r, f in found[0] if r == 0}
    assert all(0 <= f < 1 << BITS for x in found for _, f in x)


def test_null_empty_long_repeated_and_clashing(spark):
    texts = ["you vile awful fool", "a calm and pleasant day", None, "", "vile " * 200_000, "a calm and pleasant day"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "vile fool", 0.5), (5, texts[5], 0.5)], "doc_id long, text string, toxicity double")
    many = spark.createDataFrame([(100 + k, ("vile fool" if k % 2 else "calm day") + f" {k}") for k in range(400)], "doc_id long, text string")
    labels = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    odd = labels.limit(1).withColumn("toxic", F.lit(None).cast("int")).unionByName(spark.createDataFrame([(None, 1)], "doc_id long, toxic int"))
    model = fit(many, labels.unionByName(odd).unionByName(labels.limit(3)))
    rows = toxicity(docs, model).collect()
    assert len(rows) == 8 and toxicity(docs, model).columns == ["doc_id", "text", "toxicity"]
    score = {r.doc_id: r.toxicity for r in rows}
    assert score[0] > THRESHOLD > score[1] and score[None] > THRESHOLD and score[4] > 0.5
    assert score[2] == score[3] == pytest.approx(1 / (1 + math.exp(-model[0])))
    assert len({r.toxicity for r in rows if r.doc_id == 5}) == 1
    assert toxicity(docs.limit(0), model).count() == 0


def test_no_labels_at_all(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity(docs, model).first().toxicity == 0.5
