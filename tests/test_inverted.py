import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import inverted
from quern.operators import ranking as R
from quern.operators.inverted import build_index, stored_index


def corpus(spark, n=700, seed=1):
    rng = random.Random(seed)
    kinds = [[f"{p}{k}" for k in range(60)] for p in ("en", "de", "es")]
    rows = [(k * 7 - 900, " ".join(rng.choices(kinds[k % 3], [1 / (r + 1) for r in range(60)], k=rng.randrange(0, 80))) + rng.choice(["", " the of rare"]), "xyz"[k % 3]) for k in range(n)]
    asked = [(q, " ".join(rng.choices(kinds[q % 3], k=rng.randrange(1, 5))) + rng.choice(["", " en3", " zzz"])) for q in range(40)] + [(90, ""), (91, None), (92, "unknown"), (93, "the"), (94, "en1 en1 EN1")]
    return spark.createDataFrame(rows + [(10**12, None, "x"), (10**12 + 1, "", None)], "doc_id long, text string, lang string"), spark.createDataFrame(asked, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"every_term": True}, {"every_term": True, "prefix": True}, {"prefix": True}, {"k": 3}])
def test_the_same_rows_as_without_an_index(spark, options):
    docs, asked = corpus(spark)
    index = build_index(docs, ["lang"], bits=4)
    assert index.blocks.select("shard").distinct().count() > 20
    expected = rows(R.bm25(docs.select("doc_id", "text"), asked, **options))
    assert len(expected) > 30
    assert rows(index.search(asked, **options)) == expected


def test_all_matches(spark):
    docs, asked = corpus(spark, 100)
    got = build_index(docs, bits=4).search(asked, k=None)
    expected = R.bm25(docs.select("doc_id", "text"), asked, k=None)
    key = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in df.collect())
    assert key(got) == key(expected)


def test_blocks_that_cannot_matter_are_not_read(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows_ = [(k, f"w{k % 30} " * 6 + say(4), "a") if k % 400 < 60 else (k, say(60), "b") for k in range(3000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(q, f"w{q} w{(7 * q + 1) % 30}" if q % 2 else f"w{q}") for q in range(30)], "query_id long, text string")
    index = build_index(docs, ["lang"], bits=5)
    report = {r.query_id: r for r in index.postings_read(asked, 2).collect()}
    held = {(r.query_id): r.n for r in index._wanted(asked, False).join(index.terms, ["bucket", "term"]).groupBy("query_id").agg(F.sum("df").alias("n")).collect()}
    assert {q: r.postings for q, r in report.items()} == held
    assert all(r.postings_read <= r.postings and r.shards_read <= r.shards for r in report.values())
    assert sum(r.postings_read for r in report.values()) < 0.6 * sum(r.postings for r in report.values())
    assert rows(index.search(asked, 2)) == rows(R.bm25(docs.select("doc_id", "text"), asked, 2))


def test_only_the_heads_of_other_blocks_are_read(spark):
    index = build_index(corpus(spark, 50)[0], bits=4)
    plan = index.blocks.select("term", "shard", "n", "top_tf", "low_dl").where("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "docs" not in plan[plan.rindex("ReadSchema") :]


def test_blocks_of_a_shard():
    lists = pa.array([["the", "b1", "a1", "b1"], [], None, ["a1", "x"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7, 8]), pa.array([5, 3, 4, 9]), lists], ["shard", "doc_id", "words"])
    got = pa.Table.from_batches(list(inverted._blocks(iter([batch.slice(0, 1), batch.slice(1)])))).to_pylist()
    assert {(r["term"], r["shard"], r["n"], r["total"], r["top_tf"], r["low_dl"], *r["docs"], *r["tfs"], *r["dls"]) for r in got} == {("b1", 7, 1, 2, 2, 3, 5, 2, 3), ("a1", 7, 1, 1, 1, 3, 5, 1, 3), ("a1", 8, 1, 1, 1, 1, 9, 1, 1)}
    assert list(inverted._blocks(iter([]))) == []


def test_empty_tables(spark):
    docs, asked = corpus(spark, 20)
    assert build_index(docs.limit(0)).search(asked).count() == 0
    assert build_index(docs).search(asked.limit(0)).count() == 0
    assert build_index(docs.where("text IS NULL")).search(asked).count() == 0


def test_an_index_is_kept_until_its_files_change(spark, tmp_path):
    docs, asked = corpus(spark, 60)
    docs.write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    first = stored_index(read(), "t", ["lang"], {"n": F.length("text")})
    assert stored_index(read(), "t", ["lang"], {"n": F.length("text")}).path == first.path
    assert {r.doc_id: r.n for r in first.docs.collect()} == {r.doc_id: r.n for r in docs.select("doc_id", F.length("text").alias("n")).collect()}
    assert stored_index(read(), "other", ["lang"]).path != first.path
    spark.createDataFrame([(5, "en1 en1 en1", "x")], docs.schema).write.mode("append").parquet(f"{tmp_path}/d")
    again = stored_index(read(), "t", ["lang"], {"n": F.length("text")})
    assert again.path != first.path and again.n == first.n + 1
    assert np.isfinite(again.mean)


@pytest.mark.parametrize("sizes", [(2_048, 4_096), (40, 9)])
def test_documents_that_hold_all_beginnings(spark, monkeypatch, sizes):
    monkeypatch.setattr(R, "SCAN_DOCS", sizes[0])
    monkeypatch.setattr(R, "SCAN_QUERIES", sizes[1])
    docs, asked = corpus(spark)
    asked = asked.unionByName(spark.createDataFrame([(95, "en1 en12 en"), (96, "DE de1 de"), (97, "es1 zzz"), (98, "a e")], asked.schema))
    expected = rows(R.bm25(docs.select("doc_id", "text"), asked, every_term=True, prefix=True))
    assert len(expected) > 60
    assert rows(R.begins_with_all(docs.select("doc_id", "text"), asked)) == expected
    assert R.begins_with_all(docs.limit(0), asked).count() == 0
    assert R.begins_with_all(docs, asked.limit(0)).count() == 0
