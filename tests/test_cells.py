import numpy as np
from pyspark.sql import functions as F

from quern.operators.cells import Cells, build_cells
from quern.operators.ranking import vector_top
from quern.plans.registry import QUERIES

VECTOR = "vec_id long, embedding array<float>, label int"


def clustered(spark, n=1500, d=8, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    # a third of all rows in one group
    of = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, groups, n))
    return spark.createDataFrame([(int(k), [float(x) for x in centres[g] + 0.1 * rng.normal(size=d)], int(g)) for k, g in enumerate(of)], VECTOR)


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_recall_and_the_part_read(spark):
    vectors = clustered(spark)
    cells = build_cells(vectors, cells=40)
    asked = vectors.where("vec_id % 17 = 0")
    exact, got = pairs(vector_top(vectors, asked)), pairs(cells.search(asked))
    assert len(exact & got) >= 0.9 * len(exact) and len(got) == len(exact)
    assert cells.probes < 20
    assert cells.part_read(asked).agg(F.avg("part")).first()[0] < 0.5
    assert cells.members.count() == 1500
    again = Cells(spark, cells.path)
    assert (again.probes, again.n) == (cells.probes, 1500) and pairs(again.search(asked)) == got


def test_all_cells_give_the_exact_rows(spark):
    vectors = clustered(spark, 300)
    cells = build_cells(vectors, cells=10)
    asked = vectors.where("vec_id < 20")
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in df.collect())
    assert rows(cells.search(asked, 5, probes=10)) == rows(vector_top(vectors, asked, 5))


def test_only_cells_asked_for_are_read(spark):
    cells = build_cells(clustered(spark, 300), cells=10)
    plan = cells.members.where("cell = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, VECTOR)
    cells = build_cells(vectors, cells=2)
    got = cells.search(vectors.where("vec_id = 1"), 10, probes=2).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 8), (3, 2)]
    empty = build_cells(vectors.limit(0))
    assert empty.search(vectors.where("vec_id = 1")).count() == 0


def test_query_finds_what_the_exact_one_does(spark, sf_dir):
    exact, got = pairs(QUERIES["vector_topk"](spark, sf_dir)), pairs(QUERIES["cells_topk"](spark, sf_dir))
    assert len(exact & got) >= 0.9 * len(exact)
    report = QUERIES["cells_report"](spark, sf_dir).first()
    assert abs(report.recall - len(exact & got) / len(exact)) < 1e-9 and 0 < report.part_read <= 1


def test_tiles_of_cells_and_blocks_of_queries(spark, monkeypatch):
    vectors = clustered(spark, 600)
    cells = build_cells(vectors, cells=12)
    asked = vectors.where("vec_id % 7 = 0")
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in df.collect())
    whole = rows(cells.search(asked, 5, probes=3))
    monkeypatch.setattr("quern.operators.cells.BLOCK", 40)  # the cell of a third of all rows takes five tiles, others share one
    monkeypatch.setattr("quern.operators.cells.QUERY_BLOCK", 16)
    assert max(n for _, n in cells._tiles().values()) >= 5 and len(set(cells._tiles().values())) < 12
    assert rows(cells.search(asked, 5, probes=3)) == whole
    members = {r.vec_id: (r.cell, np.array(r.embedding, np.float64)) for r in cells.members.collect()}
    own = {}
    for r in cells.ordered(asked, 3).collect():
        own.setdefault(r.query_id, set()).add(r.cell)
    unit = lambda v: v / np.linalg.norm(v)
    for q, near in own.items():
        best = sorted((round(1 - unit(members[q][1]) @ unit(v), 6) + 0.0, i) for i, (cell, v) in members.items() if cell in near)[:5]
        assert [(d, i) for x, _, i, d in whole if x == q] == best
    sent = cells.search(asked, 5, probes=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "cells#" in sent  # a query's cells are a list in a row of each tile
