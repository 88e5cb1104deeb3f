"""Line dedup against SQL and against plain Python."""

from collections import defaultdict

from quern.llm.line_dedup import line_dedup, op4_line_dedup
from quern.llm.queries import ORACLE_SQL
from tests.oracle import same_rows

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, text) of each row; None ranks below every number."""
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect()), key=str)


SHARED = "a line that many documents share"


def test_op4_equals_sql(spark, sf_dir):
    assert same_rows(op4_line_dedup(spark, sf_dir), ORACLE_SQL["op4_line_dedup"], sf_dir) == 1000


def test_null_empty_long_repeated_and_clashing(spark):
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, f"{SHARED}\nown\n\t {SHARED.upper()} \x0b"), (5, f"x\n{SHARED}\n"), (6, f"{SHARED}\n{SHARED}"),
        (7, f"é{SHARED}\nÉ{SHARED}"), (8, f"é{SHARED}"), (9, f"É{SHARED}"), (None, f"{SHARED}\nby nobody"),
        (10, "\n".join([f"line {k} of a very long text" for k in range(30_000)] + [SHARED])), (11, "nineteen letters ab"), (12, "nineteen letters ab"),
        (13, "nineteen letters ab"), (14, "twenty letters a b c"), (15, "twenty letters a b c"), (16, "twenty letters a b c"),
    ]
    frame = spark.createDataFrame([(*r, 7, "k", 1) for r in rows], "doc_id long, text string, n_lines int, _key string, _pos int")
    found = line_dedup(frame)
    assert found.columns == ["doc_id", "text", "_key", "_pos", "n_lines", "n_dropped"]
    assert got(found) == brute(rows)
    assert {r._key for r in found.collect()} == {"k"}
    assert line_dedup(frame.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    """Two rows of one doc_id hold a line once; the largest doc_id keeps its line in every row."""
    for rows in (
        [(1, SHARED), (1, SHARED), (2, SHARED)],
        [(1, SHARED), (1, f"{SHARED}\nother"), (2, SHARED), (3, SHARED), (3, f"{SHARED}\nagain"), (3, f"{SHARED}\nagain")],
        [(None, SHARED), (None, SHARED), (2, SHARED), (3, SHARED)],
        [(None, SHARED)] * 3,
    ):
        assert got(line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_line_that_all_documents_hold(spark):
    rows = [(k, f"start {k}\n{SHARED}\nend {k}\n{SHARED} too") for k in range(3000)]
    assert got(line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
