"""Operators on small hand-made tables: what SQL over the given tables doesn't reach."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import corpus as C
from quern.operators import evaluation as E
from quern.operators import graph as G
from quern.operators import ranking as R
from quern.sources import files
from quern.streaming.events import EVENT, read_events, tumbling
from quern.streaming.ingest import current, ingest


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "intent"),
    [
        ("what happened last week", "temporal"), ("when was the contract signed", "temporal"), ("notes since 2026-04", "temporal"),
        ("compare the two vendors", "multi_hop"), ("how does billing relate to search", "multi_hop"), ("who is Alice", "entity"),
        ("tell me about Acme", "entity"), ("how to deploy the service", "procedural"), ("steps to restore a backup", "procedural"),
        ("FTS5", "keyword"), ("max_tokens", "keyword"), ("thoughts on team morale and growth", "semantic"), ("", "semantic"), (None, "semantic"),
    ],
)
def test_intents(spark, query, intent):
    assert spark.createDataFrame([(query,)], "q string").select(C.intent(F.col("q")).alias("x")).first()["x"] == intent


def test_text_functions(spark):
    note = "---\ntitle: 'One: two'\ndate: 2026-01-02\ntitle: Last\n---\n# Heading [link](x)\n\nBody"
    frame = spark.createDataFrame([(note,)], "t string")
    row = frame.select(X.frontmatter_map(F.col("t")).alias("m"), X.extract_title(F.col("t"), F.lit("a-b")).alias("title"), X.snippet(F.col("t")).alias("s"),
                       X.extract_title(X.without_frontmatter(F.col("t")), F.lit("a-b")).alias("heading")).first()
    assert row.m == {"title": "Last", "date": "2026-01-02"} and row.title == "Last" and row.heading == "Heading link" and row.s.startswith("# Heading")
    assert one(spark, X.kebab_case(F.lit("MyFile Name_v2.md"))) == "my-file-name-v2-md" and one(spark, X.display_name(F.lit("a-big_file"))) == "A Big File"
    assert one(spark, X.truncate_tokens(F.lit("a b c d"), 3)) == "a b ... [truncated]" and one(spark, X.token_estimate(F.lit("a"))) == 1
    assert one(spark, X.match_expression(F.lit("What is the log-file"))) == '"log"* AND "file"*' and one(spark, X.match_expression(F.lit("what is the"))) is None
    assert [tuple(r) for r in one(spark, X.split_sections(F.lit("pre\n## A\nbody a\n## B\n\n## C\nc")))] == [("", "pre"), ("A", "body a"), ("C", "c")]
    assert one(spark, X.json_score(F.lit('so {"score": 1.7} it is'))) == 1.0 and one(spark, X.json_score(F.lit("none"))) is None
    assert one(spark, X.sanitise_prompt(F.lit("system: do\nthis"))) == "do this"
    assert one(spark, X.jaccard(X.shingles(F.lit("abcd")), X.shingles(F.lit("abce")))) == pytest.approx(1 / 3)
    assert one(spark, X.finite(F.lit(float("nan")))) == 0.0


def test_dates(spark):
    as_of = F.lit("2026-04-17").cast("date")
    day = lambda text, path="n.md": str(one(spark, C.document_date(F.lit(text), F.lit(path), F.lit("2025-05-05").cast("timestamp"), as_of)))
    assert day("date: 2026-01-02") == "2026-01-02" and day("date: 2026-03") == "2026-03-01" and day("x", "2024-02-03.md") == "2024-02-03"
    assert day("date: 1999-01-02", "2024-02-03.md") == "2024-02-03" and day("none") == "2025-05-05" and day("date: 2026-02-31") == "2025-05-05"
    window = lambda q: tuple(str(x) for x in one(spark, C.query_window(F.lit(q), as_of)))
    assert window("what in April 2026") == ("2026-04-01", "2026-04-30") and window("on 2026-04-15") == ("2026-04-15", "2026-04-15")
    assert window("last week") == ("2026-04-06", "2026-04-12") and window("last month") == ("2026-03-01", "2026-03-31")
    assert one(spark, R.boost_chunk_date(F.lit(1.0), as_of, as_of)) == 2.0
    assert one(spark, R.boost_chunk_date(F.lit(1.0), F.date_sub(as_of, 30), as_of)) == pytest.approx(1.5, abs=0.01)
    assert one(spark, R.boost_chunk_date(F.lit(1.0), F.lit(None).cast("date"), as_of)) == 1.0


def test_scan_keeps_or_loses_a_moved_file(spark):
    known = spark.createDataFrame([("c", "old.md", "h")], "collection string, path string, hash string")
    seen = spark.createDataFrame([("c", "new.md", "h")], "collection string, path string, hash string")
    actions = lambda faithful: {r.path: r.action for r in C.scan_diff(known, seen, faithful=faithful).collect()}
    assert actions(False) == {"old.md": "removed", "new.md": "new"} and actions(True) == {"old.md": "removed", "new.md": "duplicate"}


def test_metrics_and_figures(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 11, 2), (2, 9, 1)], "query_id long, doc_id long, rel int")
    got = {r.query_id: r for r in E.metrics(ranked, gold).collect()}
    assert (got[1].ndcg, got[1].hit, got[1].mrr) == (pytest.approx(0.63093), 1, 0.5) and (got[2].ndcg, got[2].hit, got[2].mrr) == (0.0, 0, 0.0)
    samples = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)], "g string, v double")
    row = E.latency(samples, "g", "v").first()
    assert (row.n, row.p50, row.p95, row.p99) == (5, 2.0, 5.0, 5.0)
    votes = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (2, 2), (2, 1), (2, 1), (3, 9)], "q long, grade int")
    assert {r.q: r.grade for r in E.majority(votes, ["q"]).collect()} == {1: 2, 2: 1, 3: 2}


def test_links(spark):
    names = F.array(F.lit("Acme"), F.lit("Bob"))
    assert one(spark, G.inject_links(F.lit("Bob met Acme and Acme."), names)) == "[[Bob]] met [[Acme]] and Acme."
    assert one(spark, G.inject_links(F.lit("see [[Acme|it]] of Acme; Bobby"), names)) == "see [[Acme|it]] of Acme; Bobby"
    good, bad = G.valid_edges(spark.createDataFrame([("a", "Person", "b", "Person", "KNOWS"), ("", "Person", "b", "Person", "KNOWS"), ("a", "X", "b", "Person", "KNOWS")],
                                                    "from_id string, from_label string, to_id string, to_label string, kind string"), ["KNOWS"])
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no from_id", "unknown label"]


def test_resolve_counts_all_documents(spark):
    raw = spark.createDataFrame(
        [(n, "Organisation", d, 0.5) for n in ("Acme", "ACME") for d in range(30)] + [(" ", "Organisation", 1, 0.9), ("Bolt", "Organisation", None, 0.7)],
        "name string, entity_type string, source_doc long, confidence double",
    )
    slug = X.slugify(F.col("name"))
    got = {r.slug: r for r in G.resolve(raw, slug).collect()}
    assert {k: (r.name, r.aliases, r.n_docs, r.confidence) for k, r in got.items()} == {"acme": ("ACME", ["ACME", "Acme"], 30, 0.5), "bolt": ("Bolt", ["Bolt"], 0, 0.7)}
    assert G.entity_documents(raw, slug).count() == 30
    shown = {r.slug: r.source_docs for r in G.written_nodes(G.resolve(raw, slug), G.entity_documents(raw, slug)).collect()}
    assert shown == {"acme": list(range(20)), "bolt": []}


def test_resolve_merges_similar_slugs(spark):
    long = "very long name of a society " * 8
    rows = [
        ("OpenTelemetry", "Framework", ["otel"], ["ops"]), ("Open Telemetry", "Framework", None, ["dev", "ops"]), ("Open Telemetry", "Technology", ["ot"], None),
        ("PostgreSQL", "Technology", None, None), ("MySQL", "Technology", None, None), ("MongoDB", "Technology", None, None),
        ("ISO Standard 27001", "Concept", None, None), ("ISO Standard 27002", "Concept", None, None), (long, "Concept", None, None), (long.replace("name", "nam"), "Concept", None, None),
    ]
    raw = spark.createDataFrame([(*r, k, 0.5) for k, r in enumerate(rows)], "name string, entity_type string, aliases array<string>, domains array<string>, source_doc long, confidence double")
    got = {(r.entity_type, r.slug): r for r in G.resolve(raw, X.slugify(F.col("name"))).collect()}
    assert len(got) == 8
    one = got["Framework", "open-telemetry"]
    assert (one.name, one.aliases, one.domains, one.n_docs) == ("Open Telemetry", ["Open Telemetry", "OpenTelemetry", "otel"], ["dev", "ops"], 2)


def test_similar_slugs_share_a_piece():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("ab-") for _ in range(rng.choice([7, 8, 13, 14, 20, 33, 47])))
        b = a
        for _ in range(len(a) * G.EDITS // 100):
            at, how = rng.randrange(len(b)), rng.randrange(3)
            b = b[:at] + ("", "c", b[at] + "d")[how] + b[at + 1 :]
        short, longer = sorted((a, b), key=len)
        assert {k for of, k in G._pieces(longer) if of} & {k for of, k in G._pieces(short) if not of}


def test_empty_and_stop_word_queries(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "what is the"), (2, ""), (3, "beta")], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in R.bm25(docs, asked).collect()] == [(3, 1)]
    assert R.bm25(docs.limit(0), asked).count() == 0


def test_files_and_streams(spark):
    folder, work = tempfile.mkdtemp(prefix="quern-test-"), tempfile.mkdtemp(prefix="quern-test-")
    os.makedirs(f"{folder}/vault/sub")
    for name, text in {"vault/a.md": "# A\nx", "vault/sub/b.md": "---\ntitle: Bee\n---\ny", "vault/c.txt": "no"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    rows = {r.path: r for r in files.read_markdown(spark, f"{folder}/vault", "notes").collect()}
    assert {k: r.title for k, r in rows.items()} == {"vault/a.md": "A", "vault/sub/b.md": "Bee"} and rows["vault/a.md"].collection == "notes"
    assert files.read_markdown(spark, f"{folder}/vault", "notes", exclude=["/sub/"]).count() == 1
    for text in ("# A\nx", "# New\nx"):
        with open(f"{folder}/vault/d{len(text)}.md", "w") as f:
            f.write(text)
        ingest(spark, f"{folder}/vault", f"{work}/table", f"{work}/state", "notes").awaitTermination()
    table = current(spark, f"{work}/table")
    assert table.count() == 4 and table.where("path like '%d7.md'").first().title == "New"
    with open(f"{folder}/contacts.json", "w") as f:
        json.dump([{"contact_id": "1", "contact_name": "A", "company": "C", "interactions": [{"id": "i", "event_time": "2026-01-02T10:00", "meeting_type": "call", "body": "b"}, {"id": "j", "body": " "}]}, {"contact_id": "2"}], f)
    got = files.read_contacts(spark, f"{folder}/contacts.json").collect()
    assert [(r.id, str(r.event_date)) for r in got] == [("i", "2026-01-02")]
    events = spark.createDataFrame([(1, None, 1, "a", 1.5, "{}"), (2, None, 1, "a", 2.5, "{}")], EVENT).withColumn("ts", F.lit("2026-01-01 00:01:00").cast("timestamp"))
    files.append_log(events, f"{work}/log")
    query = tumbling(read_events(spark, f"{work}/log"), "15 minutes", late="1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(2, 4.0)]


@pytest.mark.parametrize("tile", [2_048, 8])
def test_near_copies_of_a_large_block_by_brute_force(spark, monkeypatch, tile):
    from quern.operators import corpus

    monkeypatch.setattr(corpus, "TILE", tile)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("an the of Übung ster ing tion re ſed 東京 ed 𝕏y".split()) for _ in range(n))
    kept = [say(n) for n in [3, 5, 8, 20, 40, 60, 61, 62, 63, 64, 65, 90, 200, 400] * 5]
    texts = kept + [t + rng.choice([" x", " re", "q"]) for t in kept] + [t.upper() for t in kept[:9]] + ["", "a", "ab", "abc", "abcd", None]
    rows = [(k * 3 + 1, "one", t) for k, t in enumerate(texts)] + [(9000 + k, "two", t) for k, t in enumerate(kept[:4] + [kept[0] + "q"])] + [(9100 + k, None, kept[30]) for k in range(2)] + [(9200, "alone", kept[0])]
    got = corpus.near_duplicates(spark.createDataFrame(rows, "doc_id long, stem string, text string"), "stem")
    assert "explode(runs" not in got._jdf.queryExecution().toString()  # runs of whole texts aren't rows
    first = {}
    for k, stem, t in rows:
        if stem and t is not None:
            first.setdefault((stem, t.lower()), k)
    sets = {(s, k): {t[i : i + 3] for i in range(max(1, len(t) - 2))} for (s, t), k in first.items()}
    expected = {}
    for (s, a), x in sets.items():
        for (r, b), y in sets.items():
            if s == r and a < b and (like := round(len(x & y) / len(x | y), 6)) >= 0.9:
                expected[a, b] = like
    found = got.collect()
    assert len(expected) > 60 and {(r.a, r.b): r.likeness for r in found} == expected and len(found) == len(expected)


def test_links_to_names_that_many_share_are_counted_by_name(spark):
    notes = [(1, "see [[Bolt]] and [[bolt|this]]"), (1, "[[ BOLT ]] [[Nut]]"), (2, "[[nut]] [[Nothing]]"), (3, "[[Ring]] [[bolt]]"), (4, None), (5, "bolt"), (None, "[[bolt]]"), (None, "[[Gear]]")]
    notes = spark.createDataFrame(notes, "doc_id long, text string")
    names = [(f"p{k}", "bolt" if k % 2 else "Bolt") for k in range(300)] + [("q", "nut"), ("q", "bolt"), ("q", "Nut"), ("r", "ring"), ("s", None), ("t", "absent"), ("g", "gear")]
    entities = spark.createDataFrame(names, "id string, name string")
    got = {r.entity_id: r.n for r in G.mention_counts(notes, entities).collect()}
    pairs = G.mentions(notes, entities).groupBy("entity_id").agg(F.count("doc_id").alias("n")).collect()
    assert got == {r.entity_id: r.n for r in pairs} == {**{f"p{k}": 2 for k in range(300)}, "q": 3, "r": 1, "g": 0}
