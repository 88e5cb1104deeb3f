"""Neighbours against brute force, and the Hilbert keys."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm.curves import hilbert_keys
from quern.llm.nearest import nearest, op7_nearest


def brute(rows, queries, k=10):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got = out.setdefault(r.query_id, [])
        assert r.rank == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def test_hilbert_steps_are_neighbours():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_op7_recall(spark, sf_dir):
    big = sf_dir.replace("0.01", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()]
    got, truth = answers(op7_nearest(spark, big)), brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == truth.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth) / sum(map(len, truth.values()))
    assert found >= 0.9
    for q, near in got.items():
        exact = dict(brute(rows, [q], len(rows))[q])
        assert all(abs(exact[i] - score) < 1e-12 for i, score in near)
        assert near == sorted(near, key=lambda x: (x[1], x[0]))


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(100, same), *[(i, same) for i in range(1, 60)], (200, [0.0, 1.0, 0.0]), (300, [0.0, 0.0, 0.0]), (301, None), (302, [float("nan"), 1.0, 0.0]), (303, [1.0, None, 0.0]),
            (400, [float("inf"), 0.0, 0.0]), (500, [1.0, 0.0]), (201, [0.0, 2.0, 0.0]), (202, [0.0, 0.0, 1.0]), (200, [0.0, 1.0, 0.0]), (None, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = answers(nearest(df, df.where(F.col("vec_id") % 100 == 0)))
    assert got.keys() == {100, 200}
    assert got[100] == [(i, 0.0) for i in range(1, 11)]
    assert [i for i, _ in got[200]] == [201, *range(1, 10)]
    assert nearest(df.limit(0), df).count() == 0
    few = answers(nearest(df.where("vec_id in (200, 201)"), df.where("vec_id = 200")))
    assert few == {200: [(201, 1.0)]}
