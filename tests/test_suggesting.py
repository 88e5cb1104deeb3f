import datetime

from pyspark.sql import functions as F

from quern.operators.suggesting import match_grade, memory_logs, named_things, suggested, summaries


def test_names_that_texts_suggest(spark):
    notes = [(1, "We met Alice Smith of Acme Corp. Alice Smith of IBM called.\nNothing here"), (2, None), (3, ""), (4, "The Product Owner saw Bob Jones. " + "x" * 300), (5, "lower case only, A b")]
    df = spark.createDataFrame(notes, "doc_id long, text string")
    got = {(r.doc_id, r.surface, r.label): r.text for r in named_things(df).collect()}
    assert got[1, "Alice Smith", "PERSON"] == got[1, "Acme Corp", "ORG"] == "We met Alice Smith of Acme Corp."
    assert got[1, "IBM", "ORG"] == "Alice Smith of IBM called." and {k[0] for k in got} == {1, 4}
    nodes = spark.createDataFrame([("n2", "alice smith"), ("n1", "Alice Smith"), ("x", None)], "id string, name string")
    allowed = spark.createDataFrame([("IBM", "PRODUCT")], "name string, label string")
    rows = {(r.doc_id, r.surface): (r.label, r.source, r.existing_id, r.is_new) for r in suggested(df, nodes, allowed, ["The Product Owner"]).collect()}
    assert rows == {(1, "Alice Smith"): ("PERSON", "found", "n1", False), (1, "Acme Corp"): ("ORG", "found", None, True), (1, "IBM"): ("PRODUCT", "known", None, True), (4, "Bob Jones"): ("PERSON", "found", None, True)}


def test_grades_logs_and_summaries(spark):
    pairs = [("Acme", "ACME", "high"), ("Acme", "Acme Corp", "medium"), ("Acme Corp", "acme", "medium"), ("Acme", "Globex", "low"), (None, "x", "medium"), (None, None, "high")]
    assert all(r.g == r.e for r in spark.createDataFrame(pairs, "n string, l string, e string").select(match_grade(F.col("n"), F.col("l")).alias("g"), "e").collect())
    files = spark.createDataFrame([("a/memory/2026-04-29.md",), ("2026-04-30.md",), ("2026-13-40.md",), ("x2026-04-29.md",), ("2026-04-29.md.bak",), (None,)], "path string")
    assert sorted((r.path, r.day) for r in memory_logs(files).collect()) == [("2026-04-30.md", datetime.date(2026, 4, 30)), ("a/memory/2026-04-29.md", datetime.date(2026, 4, 29))]

    def provider(path, text, bound):
        if "bad" in path:
            raise ValueError("refused")
        return f"{len(text.split())} {bound}"

    docs = spark.createDataFrame([("a", "w " * 3000), ("bad", "x"), ("none", None), ("empty", " ")], "path string, text string")
    got = sorted((r.path, r.level, r.summary, r.failed) for r in summaries(docs, provider).collect())
    assert got == [("a", "L0", "800 150", False), ("a", "L1", "2000 600", False), ("bad", "L0", None, True), ("bad", "L1", None, True)]
