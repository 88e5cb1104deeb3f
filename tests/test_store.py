import os
import random

import pytest

from quern.streaming.store import EDGE, NODE, Report, Store, crawl_into

ROW = "k long, tag string, value double"


def snapshot(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_against_a_dict(spark, tmp_path):
    rng = random.Random(1)
    store, held = Store(spark, str(tmp_path), ROW, ["k", "tag"], buckets=5), {}
    for batch in range(4):
        rows = [(rng.choice([None, *range(12)]), rng.choice(["a", None]), rng.choice([None, 1.0, 2.0]), rng.random() < 0.3, n) for n in range(14)]
        before = dict(held)
        last = {(k, t): (v, gone) for k, t, v, gone, _ in rows}
        for key, (v, gone) in last.items():
            held.pop(key, None) if gone else held.update({key: v})
        report = store.apply(spark.createDataFrame(rows, f"{ROW}, _deleted boolean, n int"), batch, ["n"])
        same = sum(1 for key, (v, gone) in last.items() if (gone and key not in before) or (not gone and key in before and before[key] == v))
        assert (report.inserted, report.deleted, report.unchanged) == (len(held.keys() - before.keys()), len(before.keys() - held.keys()), same)
        assert report.inserted + report.updated + report.deleted + report.unchanged == len(last)
        assert {(r.k, r.tag): r.value for r in store.rows().collect()} == held and store.rows().count() == len(held)
    assert store.rows(before=1).count() <= 14


def test_a_repeated_batch_changes_nothing_and_a_row_rewrites_one_partition(spark, tmp_path):
    store = Store(spark, str(tmp_path), ROW, ["k"], buckets=16)
    rows = spark.createDataFrame([(k, "x", k / 2) for k in range(200)], ROW)
    assert store.apply(rows, 0).inserted == 200
    before = snapshot(tmp_path)
    assert store.apply(rows, 1) == Report(unchanged=200) and snapshot(tmp_path) == before and store.versions() == [0]
    changed = spark.createDataFrame([(7, "y", 0.0)], ROW)
    assert store.apply(changed, 2, dry_run=True).updated == 1 and snapshot(tmp_path) == before
    report = store.apply(changed, 2)
    assert report.updated == 1 and len(report.buckets) == 1
    new = [f for f in snapshot(tmp_path) if f not in before]
    assert {f.split("bucket=")[1].split("/")[0] for f in new if "bucket=" in f} == {str(report.buckets[0])}
    assert all(snapshot(tmp_path)[f] == t for f, t in before.items())
    assert store.rows().count() == 200 and store.rows().where("k = 7").first().tag == "y"
    assert store.rows(before=2).where("k = 7").first().tag == "x"


def test_a_failed_batch_is_repeated(spark, tmp_path):
    store = Store(spark, str(tmp_path), ROW, ["k"], buckets=4)
    store.apply(spark.createDataFrame([(1, "a", 1.0)], ROW), 0)
    half = spark.createDataFrame([(9, "z", 9.0)], ROW)
    half.withColumn("bucket", half.k * 0).write.partitionBy("bucket").parquet(f"{tmp_path}/data/batch=1")  # data without a manifest
    assert [r.k for r in store.rows().collect()] == [1]
    again = spark.createDataFrame([(2, "b", 2.0)], ROW)
    for _ in range(2):  # the second time it is as if the first had not been heard of
        assert store.apply(again, 1).inserted == 1
        assert sorted(r.k for r in store.rows().collect()) == [1, 2]


def test_empty_tables_and_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path), ROW, ["k"], buckets=3)
    none = spark.createDataFrame([], ROW)
    assert store.apply(none, 0) == Report() and store.rows().count() == 0
    store.apply(spark.createDataFrame([(1, "a", 1.0)], ROW), 0)
    assert store.apply(spark.createDataFrame([(1, None, None, True), (5, None, None, True)], f"{ROW}, _deleted boolean"), 1) == Report(deleted=1, unchanged=1, buckets=store.apply(spark.createDataFrame([(1, "a", 2.0)], ROW), 1, dry_run=True).buckets)
    assert store.rows().count() == 0 and store.rows().columns == ["k", "tag", "value"]


VAULT = [
    ("02-Areas/00-Clients/Acme/Acme.md", "---\nname: Acme\ntier: client\n---\n# Acme"), ("02-Areas/00-Clients/Globex/Globex.md", "---\nname: Globex\n---\n"),
    ("02-Areas/Network/People-Notes/alice-acme.md", "---\nname: Alice Acme\norg: Acme\n---\n# Alice"), ("02-Areas/Network/People-Notes/bob-jones.md", "no fields"),
    ("05-Knowledge/01-Domain-Outcomes/ai-governance.md", "---\nname: AI Governance\n---\n"), ("01-Projects/engagement.md", "We met [[Acme]] and [[NotARealOrg]], [[Acme|them]] again."), ("01-Projects/none.md", None),
]


def test_crawl_of_a_vault(spark, tmp_path):
    nodes, edges = Store(spark, f"{tmp_path}/n", NODE, ["id"]), Store(spark, f"{tmp_path}/e", EDGE, ["from_id", "to_id", "kind"])
    notes = spark.createDataFrame(VAULT, "path string, text string")
    dry = crawl_into(nodes, edges, notes, 0, dry_run=True)
    assert (dry[0].inserted, dry[1].inserted) == (5, 2) and nodes.rows().count() == 0
    crawl_into(nodes, edges, notes, 0)
    assert {(r.id, r.label, r.name) for r in nodes.rows().collect()} == {("acme", "Organisation", "Acme"), ("globex", "Organisation", "Globex"), ("alice-acme", "Person", "Alice Acme"), ("bob-jones", "Person", "Bob Jones"), ("ai-governance", "Outcome", "AI Governance")}
    assert {tuple(r) for r in edges.rows().collect()} == {("alice-acme", "acme", "WORKS_AT"), ("01-Projects/engagement.md", "acme", "MENTIONS")}
    again = crawl_into(nodes, edges, notes, 1)
    assert again == (Report(unchanged=5), Report(unchanged=2)) and nodes.versions() == [0]
    moved = spark.createDataFrame([(p, (t or "").replace("org: Acme", "org: Globex").replace("name: Globex", "name: Globex\nx: y")) for p, t in VAULT], "path string, text string")
    assert crawl_into(nodes, edges, moved, 2)[1].inserted == 1
    assert crawl_into(nodes, edges, notes.limit(0), 3) == (Report(), Report())


@pytest.mark.parametrize("name", ["store_upserts"])
def test_query_reports(spark, sf_dir, name):
    from quern.plans.curation import order_store

    _, reports = order_store(spark, sf_dir)
    assert reports[0].inserted > 0 and reports[1].updated > 0 and reports[1].deleted > 0 and reports[2].buckets == ()
