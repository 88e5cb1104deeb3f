import datetime
import math
import random
import time

from quern.operators.corpus import overlapping_paths
from quern.operators.evaluation import drift_gates
from quern.operators.timeline import asked_for, dated_chunks, timeline, write_chunks
from pyspark.sql import functions as F

D = datetime.date


def test_chunks_of_logs_and_boards(spark):
    notes = [
        ("a/memory/2026-04-29.md", "# Log\nintro\n## Session — one\nsaid [decision] x\n## Two\nend"), ("memory/2026-13-40.md", "## bad day\n- [ ] 2026-01-01 x"),
        ("board.md", "## To do\n- [ ] Ship it @{2026-05-01}\n- [x] undated\n* 2026-05-02 call\ntext 2026-05-03"), ("n.md", None), ("e.md", ""),
    ]
    got = {(r.path, r.seq, r.chunk_type, r.title, r.chunk_date) for r in dated_chunks(spark.createDataFrame(notes, "path string, text string")).collect()}
    assert got == {
        ("a/memory/2026-04-29.md", 0, "memory_section", "Session — one", D(2026, 4, 29)), ("a/memory/2026-04-29.md", 1, "memory_section", "Two", D(2026, 4, 29)),
        ("board.md", 0, "board_card", "Ship it", D(2026, 5, 1)), ("board.md", 2, "board_card", "call", D(2026, 5, 2)),
    }


def test_searches_in_their_time(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    rows = [(k, say(rng.randrange(0, 30)), D(2026, 1, 1) + datetime.timedelta(k % 60)) for k in range(400)] + [(1000, "w1 w2", None)]
    write_chunks(spark.createDataFrame(rows, "chunk_id long, text string, chunk_date date"), f"{tmp_path}/c")
    chunks = spark.read.schema("chunk_id long, text string, chunk_date date").parquet(f"{tmp_path}/c")
    asked = [(1, "w1 w2 on 2026-01-05"), (2, "w3 in January 2026"), (3, "w4 w5 2026-02"), (4, "w1 2099-01-01"), (5, "w9 yesterday"), (6, "zzz today")]
    as_of = D(2026, 1, 11)
    spans = {1: (D(2026, 1, 5),) * 2, 2: (D(2026, 1, 1), D(2026, 1, 31)), 3: (D(2026, 2, 1), D(2026, 2, 28)), 4: (D(2099, 1, 1),) * 2, 5: (D(2026, 1, 10),) * 2, 6: (as_of,) * 2}
    other = spark.createDataFrame([(q, 7, 0.5, 1) for q in range(1, 8)], "query_id long, doc_id long, score double, rank int")

    def expected(q, terms, span):
        held = [(i, t.split()) for i, t, d in rows if span is None or (d and span[0] <= d <= span[1])]
        mean = sum(len(t) for _, t in held) / max(len(held), 1)
        scores = {}
        for term in terms:
            df = sum(term in t for _, t in held)
            for i, t in held:
                if tf := t.count(term):
                    scores[i] = scores.get(i, 0) + max(1e-6, math.log((len(held) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:10]
        return [(q, i, -s, n, False) for n, (s, i) in enumerate(best, 1)] or [(q, 7, 0.5, 1, True)]

    for more, timeless in ((asked, False), ([*asked, (7, "w1 w8")], True)):
        got = timeline(spark.createDataFrame([(q, t, as_of) for q, t in more], "query_id long, text string, as_of date"), chunks, other)
        want = sum((expected(q, [w for w in t.split() if w[0] in "wz"], spans.get(q)) for q, t in more), [])
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"], r.fell_back) for r in got.collect()) == sorted(want)
    plan = chunks.where(F.col("chunk_date").between("2026-01-05", "2026-01-06"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk_date" in plan
    none = timeline(spark.createDataFrame([], "query_id long, text string, as_of date"), chunks, other.limit(0))
    assert none.count() == 0


def test_what_is_asked_for(spark):
    df = spark.createDataFrame([("what happened on 2026-04-15 at Acme",), ("Last week's plan, May 2026",), (None,)], "t string")
    assert [r[0] for r in df.select(asked_for(F.col("t"))).collect()] == ["what happened on at Acme", "'s plan,", None]


def test_drift_gates(spark):
    runs = [("flat", k, 200.0, "a") for k in range(5)] + [("slow", k, 100.0 + 40 * k, "a") for k in range(5)] + [("quick", k, 10.0 * (k + 1), "a") for k in range(5)]
    runs += [("other", 0, 200.0, "a"), ("other", 1, 200.0, "b"), ("other", 2, 900.0, None), ("once", 3, 500.0, None), ("null", 0, None, None), ("null", 1, 9e9, None), ("slow", 2, 999.0, "z")]
    got = {(r.workload, r.kind, r.iteration, r.baseline, r.value) for r in drift_gates(spark.createDataFrame(runs, "workload string, iteration int, ms double, signature string")).collect()}
    assert got == {("slow", "time_drift", 2, 100.0, 180.0), ("other", "signature_mismatch", 1, None, None), ("other", "time_drift", 2, 200.0, 900.0)}


def test_overlapping_paths(spark):
    given = [("a", "x/y"), ("b", "x/y/z/"), ("c", "x/yy"), ("d", "x/y"), ("e", ""), ("f", None), ("g", "x"), ("h", "/x"), ("i", "/"), ("a", "x/y")]
    got = {(r.name, r.other_name, r.kind) for r in overlapping_paths(spark.createDataFrame(given, "name string, path string")).collect()}
    assert got == {("b", "a", "overlaps"), ("b", "d", "overlaps"), ("b", "g", "overlaps"), ("a", "g", "overlaps"), ("d", "g", "overlaps"), ("c", "g", "overlaps"), ("d", "a", "duplicates")}
    many = spark.range(1_000_000).selectExpr("concat('n', id) AS name", "concat_ws('/', id % 1000, id % 7919, id) AS path")
    began = time.time()
    found = overlapping_paths(many.union(spark.createDataFrame([("top", "7")], "name string, path string")))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 1000
    assert time.time() - began < 60
