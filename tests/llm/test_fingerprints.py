"""Fingerprints against texts edited in Python and exact containment."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.llm.fingerprints import containment, merge, next_below, op1_fingerprints, with_sketch


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def contained(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / min(len(a), len(b)) if a and b else 0.0


def check(rows, docs):
    ids = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    errors = []
    for k, i in enumerate(ids):
        text, after = docs[i], docs[ids[(k + 1) % len(ids)]]
        m = len(text) // 3
        edited, r = text[: len(text) - m] + after[:m], got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, exact in ((r.near_edited, contained(text, edited)), (r.near_next, contained(text, after))):
            assert 0 <= value <= 1 and abs(value - exact) < 0.3
            errors.append(abs(value - exact))
            if max(len(shingles(text)), len(shingles(edited)), len(shingles(after))) < 60:
                assert value == pytest.approx(exact)
    assert sum(errors) <= 0.03 * len(errors)
    return got


def test_op1(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = check(op1_fingerprints(spark, sf_dir).collect(), docs)
    by_text = {}
    for i, text in docs.items():
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (5, "é ü ß"), (9, "a b c d e f " * 4000), (7, "\n \t"), (-3, "one"), (10**15, "a b c d e f g")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sketch int").write.parquet(f"{tmp_path}/documents.parquet")
    check(op1_fingerprints(spark, str(tmp_path)).collect(), {i: t or "" for i, t in rows})


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (2, "d e f"), (None, "g h i j k l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_fingerprints(spark, str(tmp_path)).collect()
    assert len(out) == 4 and {r.edited_sha256 for r in out if r.doc_id == 2} == {hashlib.sha256(b"d e a").hexdigest()}
    assert [r.edited_sha256 for r in out if r.doc_id is None] == [hashlib.sha256(b"g h i j k l").hexdigest()]
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op1_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_merged_sketch_is_the_sketch_of_both(spark):
    a, b = " ".join(f"x{i}" for i in range(3000)), " ".join(f"y{i}" for i in range(90))
    df = with_sketch(with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    r = df.select(containment(F.col("sa"), merge(F.col("sa"), F.col("sb"))).alias("in_a"), containment(F.col("sb"), merge(F.col("sa"), F.col("sb"))).alias("in_b"),
                  containment(F.col("sa"), F.col("sb")).alias("apart")).first()
    assert (r.in_a, r.in_b, r.apart) == (1.0, 1.0, 0.0)


def test_next_below_over_many_blocks(spark):
    ids = [-(1 << 63), -5, 0, 3, *range(100, 400, 7), (1 << 63) - 1]
    got = {r.doc_id: r.next for r in next_below(spark.createDataFrame([(i,) for i in ids], "doc_id long"), block_rows=7).collect()}
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}
    assert next_below(spark.createDataFrame([], "doc_id long")).count() == 0
