"""Mixing against SQL and its promises at the edges."""

import re
from collections import defaultdict

import pytest

from quern.llm.mixing import mix, mixed_documents, op6_mixing
from quern.llm.queries import ORACLE_SQL
from tests.oracle import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1)):
    """{source: target} by sharing what is over the caps again, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, found, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            found[s] = 2.0 * sizes[s]
        left -= sum(found[s] for s in over)
        open_ -= over
    return found


def test_op6_equals_sql(spark, sf_dir):
    assert same_rows(op6_mixing(spark, sf_dir), ORACLE_SQL["op6_mixing"], sf_dir) == 1000


def test_op6_comes_near_its_targets(spark, sf_dir):
    taken, target = defaultdict(int), {}
    for r in op6_mixing(spark, sf_dir).collect():
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[k] - target[k]) <= 0.05 * target[k] + 500 for k in target)


ROWS = [
    *[(k, "word " * (k % 7), "web") for k in range(200)], *[(k, "a b c", "Zeit") for k in range(200, 230)], (300, None, "web"), (301, "", None), (302, "x y", None), (302, "x y", None),
    (None, "n u l l", "web"), (303, "long " * 60_000, "books"), (304, "short", "books"), (305, " \t\n", "blank"),
]


def test_null_empty_long_repeated_and_clashing(spark):
    frame = spark.createDataFrame([(*r, 9, "b") for r in ROWS], "doc_id long, text string, source string, copies int, size string")
    rows = mix(frame).collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += len(WORD.findall(text or ""))
    expected = targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    for r in rows:
        assert r.target == pytest.approx(expected[by_size[r.source_size]])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
    assert len({r.copies for r in rows if r.doc_id == 302}) == 1
    copies = {r.doc_id: r.copies for r in rows}
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert r.copies == 9 and r.size == "b"
    assert all(got[i] == n * (2 if i == 302 else 1) for i, n in copies.items())
    assert mix(frame.limit(0)).count() == 0 and mixed_documents(frame.limit(0)).count() == 0


def test_reruns_agree_and_a_hot_source(spark):
    rows = [(k, "w " * (1 + k % 5), "hot" if k % 3 else f"s{k % 11}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.doc_id, r.taken) for r in mix(frame.repartition(n)).collect()) for n in (3, 8))
    assert one == two


@pytest.mark.parametrize("source", ["only", None])
def test_one_source(spark, source):
    rows = mix(spark.createDataFrame([(k, "a b", source) for k in range(100)], "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in rows) == 300 and {r.target for r in rows} == {300.0}
