import json

from quern.sources.files import load_graph, read_reported
from quern.sources.formats import faults, register

OVERRIDES = '''# Overrides
prose - "not an item": ORG
- "Acme Corp": ORG
  - "iPad": PRODUCT, case_insensitive: true
- "Bob": PERSON, case_insensitive: no, other: 1
- Acme: ORG
- "X": WRONG
- "Y": ORG trailing
- "  ": ORG
-
'''
TABLES = '''| Early | `[[Early]]` | `x/` |
## Clients of ours
| Entity | Link | Path |
|---|:---:|---|
| Acme-Corp | `[[Acme-Corp]]` | `02-Areas/Clients/Acme-Corp/` |
| Gamma Systems | `[[Gamma-Systems\\|Gamma Systems]]` | `g/ (old)` |
| Acme-Corp | `[[Other]]` | `y/` |
## Notes
| broken | row |
## Key people
| Alice | `[[Alice S\\|Ali]]` | `people/alice.md` | more |
| Nobody | `[[Nobody]]` | ` ` |
'''


def test_override_lists_and_entity_tables(spark, tmp_path):
    register(spark)
    (tmp_path / "a/sub").mkdir(parents=True)
    (tmp_path / "a/o.md").write_text(OVERRIDES)
    (tmp_path / "a/sub/empty.md").write_text("")
    (tmp_path / "a/no.txt").write_text('- "Z": ORG')
    (tmp_path / "t.md").write_text(TABLES)
    df = spark.read.format("override_list").load(f"{tmp_path}/a")
    assert df.rdd.getNumPartitions() == 2
    rows = df.collect()
    assert {(r.line, r.term, r.label) for r in rows if r.term} == {(3, "Acme Corp", "ORG"), (4, "iPad", "PRODUCT"), (4, "IPAD", "PRODUCT"), (4, "ipad", "PRODUCT"), (4, "Ipad", "PRODUCT"), (5, "Bob", "PERSON")}
    assert {(r.fault, r.n, r.first_line) for r in faults(df).collect()} == {("not an entry", 4, 6), ("unknown label WRONG", 1, 7)}
    assert df.where("label = 'ORG'").select("term").collect()[0].term == "Acme Corp"
    got = spark.read.format("entity_table").load(f"file://{tmp_path}/t.md").collect()
    assert [(r.line, r.name, r.aliases, r.page, r.type) for r in got if r.name] == [
        (1, "Early", [], "x/", "unknown"), (5, "Acme-Corp", [], "02-Areas/Clients/Acme-Corp/", "organisation"),
        (6, "Gamma Systems", ["Gamma-Systems"], "g/", "organisation"), (11, "Alice", ["Alice S", "Ali"], "people/alice.md", "person"),
    ]
    assert [(r.line, r.fault) for r in got if r.fault] == [(9, "not a row of an entity"), (12, "no page")]
    assert spark.read.format("override_list").load(f"{tmp_path}/none").count() == 0


def test_broken_records_are_told(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"id": 1, "t": "a"}\n\n{"id": 2, "t": \nnot json\n{"id": "x"}\n{"id": 3, "more": 1}\n[]\n')
    rows, broken = read_reported(spark, f"{tmp_path}/log.json", "id long, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "a"), (3, None)]
    assert {r.record for r in broken.collect()} == {'[]', '{"id": "x"}', '{"id": 2, "t": ', "not json"}
    assert all(r.path.endswith("log.json") for r in broken.collect())


def test_graph_files(spark, tmp_path):
    nodes = [{"id": "a", "label": "Person", "name": "A"}, {"id": "a", "label": "Person", "name": "B"}, {"id": "", "label": "Person"}, {"id": "d", "label": "Document"}, {"id": "z", "label": "Odd"}, {"label": "Person"}]
    edges = [{"from_id": "d", "from_label": "Document", "to_id": "a", "to_label": "Person", "kind": "MENTIONS", "props": {"n": "1"}}, {"from_id": "d", "from_label": "Document", "to_label": "Person", "kind": "MENTIONS"}, {"from_id": "d", "from_label": "Document", "to_id": "a", "to_label": "Person", "kind": "LIKES"}]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/1.json").write_text(json.dumps(nodes, indent=1))
    (tmp_path / "n/2.json").write_text('[{"id": "b", "label"')
    (tmp_path / "e.json").write_text(json.dumps(edges))
    good, linked, report = load_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e.json", ["MENTIONS"])
    assert {(r.id, r.name) for r in good.collect()} == {("a", "A")}
    assert [(r.from_id, r.to_id, r.props) for r in linked.collect()] == [("d", "a", {"n": "1"})]
    assert sorted((r.source, r.record, r.reason) for r in report.collect()) == [
        ("edges", "d -> ?", "no to_id"), ("edges", "d -> a", "unknown kind"), ("nodes", "", "no id"), ("nodes", "?", "no id"),
        ("nodes", '[{"id": "b", "label"', "no array of such records"), ("nodes", "d", "made by edges"), ("nodes", "z", "unknown label"),
    ]
