import random
import re

from quern.operators.dictionary import dictionary, entities_to_link, first_mentions, linked_notes, name_mentions
from quern.plans.registry import QUERIES

ENTITY = "id string, name string, aliases array<string>, vault_path string"
NOTE = "doc_id long, path string, text string"


def test_notes_of_a_vault(spark):
    entities = spark.createDataFrame([
        ("acme", "Acme-Corp", ["Acme Corporation"], "02-Areas/Acme-Corp/"), ("alice", "Alice Smith", ["Alice"], "people/alice.md"),
        ("sys", "Gamma", None, None), ("gs", "Gamma Systems", None, ""), ("cpp", "C++", None, None), ("none", "--", ["", None], None), ("null", None, ["x"], None),
        ("twin1", "Delta", None, "a.md"), ("twin2", "Delta", None, "b.md"),
    ], ENTITY)
    notes = [
        (1, "n/1.md", "Acme-Corp shipped. Acme-Corp shipped v2."), (2, "n/2.md", "nothing here: acme-corps, xAlice, Gammas"),
        (3, "02-Areas/Acme-Corp/home.md", "Acme-Corp and Alice met."), (4, "people/alice.md", "I am Alice Smith of Acme Corporation!"),
        (5, "n/archive/5.md", "Alice"), (6, "workspace/x.md", "Alice"), (7, "workspace/a/memory/x.md", "Alice"),
        (8, "n/8.md", "  (Gamma Systems, Gamma; C++ and `Alice` in [[Acme-Corp|Acme Corporation]] Acme-Corp)\n```\nAlice\n``` Alice"),
        (9, "n/9.md", None), (10, "n/10.md", ""), (11, "a.md", "Delta"), (12, "n/12.md", "Delta [[ Alice ` C"), (13, "n/13.md", "Alice Smith, Alice"),
    ]
    got = {r.doc_id: (r.text, list(r.links)) for r in linked_notes(spark.createDataFrame(notes, NOTE), entities).collect()}
    assert got == {
        1: ("[[Acme-Corp]] shipped. Acme-Corp shipped v2.", ["acme"]), 2: (notes[1][2], []),
        3: ("Acme-Corp and [[Alice Smith|Alice]] met.", ["alice"]), 4: ("I am Alice Smith of [[Acme-Corp|Acme Corporation]]!", ["acme"]),
        5: ("Alice", []), 6: ("Alice", []), 7: ("[[Alice Smith|Alice]]", ["alice"]),
        8: ("  ([[Gamma Systems]], [[Gamma]]; [[C++]] and `Alice` in [[Acme-Corp|Acme Corporation]] Acme-Corp)\n```\nAlice\n``` [[Alice Smith|Alice]]", ["alice", "cpp", "gs", "sys"]),
        9: (None, []), 10: ("", []), 11: ("[[Delta]]", ["twin2"]), 12: ("[[Delta]] [[ [[Alice Smith|Alice]] ` C", ["alice", "twin1"]), 13: ("[[Alice Smith]], Alice", ["alice"]),
    }
    assert linked_notes(spark.createDataFrame(notes, NOTE), entities.limit(0)).where("size(links) > 0").count() == 0
    assert linked_notes(spark.createDataFrame([], NOTE), entities).count() == 0


def plain_mentions(text, names):
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    found = []
    for i, (a, _) in enumerate(words):
        for name in names:
            n = len(re.findall(r"\w+", name))
            if text.startswith(name, a) and i + n <= len(words) and words[i + n - 1][1] <= a + len(name) and re.fullmatch(r"\w+(\W+\w+)*", name) and words[i + n - 1][1] == a + len(name):
                found.append((i, n, name))
    return {f for f in found if not any(g[0] < f[0] + f[1] and f[0] < g[0] + g[1] and (g[1] > f[1] or (g[1] == f[1] and g[0] < f[0])) for g in found)}


def test_random_texts(spark):
    rng = random.Random(1)
    say = lambda n, by: by.join(rng.choice(["a", "b", "c", "A"]) for _ in range(n))
    names = sorted({say(rng.randrange(1, 5), rng.choice([" ", "-"])) for _ in range(25)})
    texts = [(k, say(rng.randrange(0, 40), rng.choice([" ", " ", "-", ", "]))) for k in range(80)]
    entities = spark.createDataFrame([(f"e{k}", name, None, None) for k, name in enumerate(names)], ENTITY)
    got = {}
    for r in name_mentions(spark.createDataFrame(texts, "doc_id long, text string"), dictionary(entities)).collect():
        got.setdefault(r.doc_id, set()).add((r["at"], r.n, r.name))
    assert got == {k: m for k, t in texts if (m := plain_mentions(t, names))}


def test_names_come_from_a_table(spark):
    entities = spark.createDataFrame([(f"e{k}", f"name {k}", None, None) for k in range(5000)], ENTITY)
    notes = spark.createDataFrame([(k, f"p{k}", f"is name {k} name {k + 1}, name 9999?") for k in range(100)], NOTE)
    found = first_mentions(notes, entities)
    assert "name 4999" not in found._jdf.queryExecution().toString()
    assert {(r.doc_id, r.entity_id) for r in found.collect()} == {(k, f"e{k + j}") for k in range(100) for j in (0, 1)}


def test_note_links(spark, sf_dir):
    from quern.plans.graphs import named_entities, order_notes

    entities = {r.id: r for r in named_entities(spark, sf_dir).collect()}
    names = {r.name: r for r in entities.values()}
    rows = QUERIES["note_links"](spark, sf_dir).collect()
    notes = {r.doc_id: r for r in order_notes(spark, sf_dir).collect()}
    assert len(rows) == len(notes)
    some = [r for r in rows if r.doc_id % 50 == 0]
    for r in some:
        note = notes[r.doc_id]
        linked = set(re.findall(r"\[\[([^\]]+)\]\]", note.text))
        shown = re.sub(r"\[\[[^\]]*\]\]", lambda m: "_" * 3, note.text)
        expected = {names[m[2]].id for m in plain_mentions(shown, list(names)) if m[2] not in linked and names[m[2]].vault_path != note.path}
        assert set(r.links) == (set() if "/archive/" in note.path else expected)


def test_names_of_a_small_graph_come_from_tables(spark):
    graph = [(f"n{k}", "Person" if k % 2 else "Organisation", f"N{k}", None, f"p/{k}.md") for k in range(5)] + [("x", "Concept", "X", None, "x.md"), ("y", "Person", "Y", None, "")]
    nodes = spark.createDataFrame(graph, "id string, label string, name string, aliases array<string>, vault_path string")
    rows = spark.createDataFrame([("T", ["Tee"], "t.md", None), (None, None, None, "no page")], "name string, aliases array<string>, page string, fault string")
    assert sorted(r.id for r in entities_to_link(nodes, rows).collect()) == [f"n{k}" for k in range(5)]
    assert [(r.id, r.aliases, r.vault_path) for r in entities_to_link(nodes.where("id <> 'n1'"), rows).collect()] == [("T", ["Tee"], "t.md")]
