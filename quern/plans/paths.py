"""Queries over paths, owners, entities named by folders, and audits of the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import graph as G
from quern.plans.graphs import _G, edges, nodes
from quern.plans.tables import DOCS, documents, table

#: Forms of paths; an order's number takes its turn and fills in the stars.
FORMS = [
    "docs/.github/note-*.md", "src/vendor/lib-*.md", "guide/zh/page-*.md", "pkg-*/LICENSE", "clients/Acme-*.md", "team/people/jo_*.md", "lib/frameworks/SCRUM-*.md", "docs/CONTRIBUTING.md",
    "notes/2024-01-0*.md", "build/out-*.txt", "how-to/install-*.md", "partners/acme-*.md", "shared/drafts/skip-*.md", "agents/one/log-*.md", "agents/two/sub/log-*.md", "agents/onetwo/log-*.md", "plain/page-*.md",
]


def files(spark, sf_dir):
    """(id, source, path, mtime): a path of each order."""
    o = table(spark, sf_dir, "orders")
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("o_orderkey") % len(FORMS) + 1).cast("int"))
    number = (F.col("o_orderkey") % 89).cast("string")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("source"), F.replace(form, F.lit("*"), number).alias("path"), F.to_date("o_orderdate").alias("mtime"))


_FILES = f"""files AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS source, replace(({FORMS!r})[o_orderkey % {len(FORMS)} + 1], '*', CAST(o_orderkey % 89 AS VARCHAR)) AS path, o_orderdate::DATE AS mtime FROM orders)"""
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_BOILER = f"(list_contains({_LIST(C.BOILERPLATE_NAMES)}, lower(regexp_extract(path, '[^/]*$'))) OR len(list_filter({_LIST(C.BOILERPLATE_PARTS)}, lambda x: contains(path, x))) > 0)"
_TRANS = f"(len(list_filter({_LIST(C.TRANSLATION_PARTS)}, lambda x: contains(lower(path), x))) > 0)"


def path_filters(spark, sf_dir):
    """What each form of path is taken for."""
    f = files(spark, sf_dir)
    return f.groupBy(C.boilerplate(F.col("path")).alias("boilerplate"), C.translation(F.col("path")).alias("translation")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def _sources(spark):
    return spark.createDataFrame([(0, 1, None), (1, 2, ["drafts/"]), (2, 3, ["drafts/", "install"]), (3, 4, None), (4, 3, [])], "source int, tier int, excludes array<string>")


def included_files(spark, sf_dir):
    return C.included(files(spark, sf_dir), F.broadcast(_sources(spark))).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def paths_within(spark, sf_dir):
    """Files that a set of paths lets through, and all where the set is empty."""
    f = files(spark, sf_dir)
    some = f.where(F.col("id") % 7 == 0).select("path")
    return C.within_paths(f, some).agg(F.count("*").alias("n")).withColumn("filter", F.lit("some")).unionByName(
        C.within_paths(f, some.limit(0)).agg(F.count("*").alias("n")).withColumn("filter", F.lit("empty")))


def path_owners(spark, sf_dir):
    registry = spark.createDataFrame([("one", "agents/one"), ("two", "agents/two/"), ("shared", "shared")], "owner string, write_path string")
    return C.owners(files(spark, sf_dir).select("id", "path"), registry).groupBy("owner").agg(F.count("*").alias("n"))


def stale_summaries(spark, sf_dir):
    f = files(spark, sf_dir).groupBy("path").agg(F.max("mtime").alias("mtime"), F.count("*").alias("n"))
    stored = f.where(F.col("n") % 2 == 0).select("path", F.date_sub("mtime", (F.col("n") % 3).cast("int")).alias("mtime"))
    return C.stale(f.select("path", "mtime"), stored)


def folder_entities(spark, sf_dir):
    return G.folder_entities(files(spark, sf_dir).withColumn("active", (F.col("id") % 4 != 0).cast("int")))


def note_targets(spark, sf_dir):
    """Where notes of conversations go, by class."""
    turns = table(spark, sf_dir, "conversations")
    marks = F.element_at(F.array(*[F.lit(x) for x in ("## 10:15 stand-up\n", "Workflow: ", "rule: ", "how to ", "Rationale: ", "at 10.0.0.1 ", "")]), (F.col("turn") % 7 + 1).cast("int"))
    kind = C.note_class(F.concat(marks, F.col("text")))["kind"]
    agent = F.when(F.col("conv_id") % 2 == 0, "shared").otherwise("one")
    return turns.select(C.note_target(agent, kind, F.lit("2024-01-02").cast("date")).alias("target"), kind.alias("kind")).groupBy("kind", "target").agg(F.count("*").alias("n"))


def phantom_entities(spark, sf_dir):
    """Names that a substring search finds in parts' names, and which of them are meant."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    text = F.concat(F.lit("we sell "), "p_type", F.lit(" goods, "), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("X"))))
    return p.select("p_partkey", G.named_in(F.col("p_brand"), F.substring_index("p_type", " ", 1), text).alias("kept"))


def suggestion_filters(spark, sf_dir):
    """Words of orders' priorities and statuses as what a recogniser found."""
    o = table(spark, sf_dir, "orders")
    labels = F.element_at(F.array(*[F.lit(x) for x in ("ORG", "DATE", "PERSON", "MONEY", "GPE")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    found = o.select(F.col("o_orderkey").alias("doc_id"), F.substring_index("o_orderpriority", "-", -1).alias("surface"), labels.alias("label"), F.lit("").alias("text"))
    allowed = spark.createDataFrame([("urgent", "PRODUCT")], "name string, label string")
    return G.suggestions(found, allowed, ["low", "Medium"]).groupBy("surface", "label", "source").agg(F.count("*").alias("n"))


def stub_faults(spark, sf_dir):
    """Pages of entities made from customers, with one fault or another."""
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, F.lit("vendor")).otherwise(F.lit("person"))
    field = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    fields = F.map_from_entries(F.filter(F.array(
        field("type", kind), field("name", F.when(k % 7 == 0, F.lit("Project")).otherwise(F.col("c_name"))),
        field("entity-id", F.lit("x")), F.struct(F.when(k % 3 == 0, F.lit("made")).otherwise(F.lit("created")).alias("key"), F.lit("2024-01-01").alias("value"))), lambda x: x["key"].isNotNull()))
    body = F.concat(F.repeat(F.lit("a line\n\n"), (k % 40).cast("int")), F.when(k % 2 == 0, F.lit("## Related\n")).otherwise(F.lit("")), F.when(k % 11 == 0, F.lit("appears in 12 documents")).otherwise(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(G.stub_faults(fields, body, body, ["project"]), ",").alias("faults"))


def curator_health(spark, sf_dir):
    seen = nodes(spark, sf_dir).withColumn("last_seen", F.date_sub(F.lit("2024-06-30").cast("date"), (F.length("name") * 10).cast("int")))
    return G.curator_health(seen, F.lit("2024-06-30").cast("date"))


def prune_candidates(spark, sf_dir):
    paths = nodes(spark, sf_dir).where(F.col("vault_path").isNotNull() & (F.length("vault_path") % 2 == 0)).select(F.col("vault_path").alias("path"))
    return G.prune_reasons(nodes(spark, sf_dir), paths)


def purge_log(spark, sf_dir):
    """What is left after the candidates are purged, and after a dry run."""
    out = None
    for dry in (True, False):
        left, links, log = G.purge(nodes(spark, sf_dir), edges(spark, sf_dir), prune_candidates(spark, sf_dir), dry)
        for name, df in (("nodes", left), ("edges", links), ("log", log)):
            row = df.agg(F.count("*").alias("n")).select(F.lit(dry).alias("dry_run"), F.lit(name).alias("part"), "n")
            out = row if out is None else out.unionByName(row)
    return out


def label_counts(spark, sf_dir):
    return G.count_by_label(nodes(spark, sf_dir))


def link_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    note = F.concat(F.lit("see [["), "p_brand", F.lit("|"), "p_type", F.lit("]] and [["), "p_brand", F.lit("|"), F.lower("p_brand"), F.lit("]] or [[Plain]]"))
    return G.aliases_of(p.select(note.alias("text")))


def linkable_notes(spark, sf_dir):
    o = files(spark, sf_dir)
    path = F.element_at(F.array(F.concat(F.lit("a/archive/"), "path"), F.concat(F.lit("workspace/"), "path"), F.concat(F.lit("Workspace/x/memory/"), "path"), F.col("path")), (F.col("id") % 4 + 1).cast("int"))
    return o.groupBy((F.col("id") % 4).cast("int").alias("form"), G.link_eligible(path).alias("eligible")).agg(F.count("*").alias("n"))


def entity_ids_set(spark, sf_dir):
    """A number from outside set on every third node."""
    new = nodes(spark, sf_dir).where(F.length("name") % 3 == 0).select("id", F.concat(F.lit("Q"), F.length("name").cast("string")).alias("wikidata_qid"))
    return G.set_field(nodes(spark, sf_dir), new, "wikidata_qid").groupBy("label", "wikidata_qid").agg(F.count("*").alias("n"))


def find_entities(spark, sf_dir):
    """Nodes of asked names in any case, the smallest id of each."""
    asked = nodes(spark, sf_dir).where(F.col("label") != "Technology").select(F.upper("name").alias("asked")).distinct()
    met = asked.join(nodes(spark, sf_dir).select("id", F.lower("name").alias("_name")), F.lower("asked") == F.col("_name"))
    return met.groupBy("asked").agg(F.min("id").alias("id"))


def link_targets(spark, sf_dir):
    """Organisations and persons with a path, which notes may link to."""
    both = nodes(spark, sf_dir).where((F.col("label") == "Organisation") & F.col("vault_path").isNotNull()).unionByName(
        nodes(spark, sf_dir).where((F.col("label") == "Person") & F.col("vault_path").isNotNull()))
    return both.select("id", "name", "vault_path")


def canonical_of_near_copies(spark, sf_dir):
    """One document of each class of near copies: the longest body, then the smallest path."""
    from quern.operators.components import components
    from quern.plans.curation import near_duplicates_blocked

    roots = components(near_duplicates_blocked(spark, sf_dir).select("a", "b"))
    docs = documents(spark, sf_dir).select("doc_id", "path", F.length("text").alias("length"))  # texts don't go to the join
    docs = docs.join(roots.withColumnRenamed("id", "doc_id").withColumnRenamed("root", "class"), "doc_id")
    return C.canonical(docs, "class", F.col("length"))


QUERIES = {
    "path_filters": path_filters, "included_files": included_files, "paths_within": paths_within, "path_owners": path_owners, "stale_summaries": stale_summaries,
    "folder_entities": folder_entities, "note_targets": note_targets, "phantom_entities": phantom_entities, "suggestion_filters": suggestion_filters, "stub_faults": stub_faults,
    "curator_health": curator_health, "prune_candidates": prune_candidates, "purge_log": purge_log, "label_counts": label_counts, "link_aliases": link_aliases,
    "linkable_notes": linkable_notes, "entity_ids_set": entity_ids_set, "find_entities": find_entities, "link_targets": link_targets, "canonical_of_near_copies": canonical_of_near_copies,
}
_PRUNE = f"""{_G}, there AS (SELECT DISTINCT vault_path AS path FROM nodes WHERE vault_path IS NOT NULL AND length(vault_path) % 2 = 0),
prune AS (SELECT * FROM (SELECT id, name, label, CASE WHEN coalesce(vault_path, '') <> '' AND path IS NULL THEN 'file_missing' WHEN coalesce(vault_path, '') = '' AND coalesce(summary, '') = '' THEN 'no_stub_no_summary' END AS reason
  FROM nodes LEFT JOIN there ON vault_path = path WHERE label IN ('Organisation', 'Person', 'Outcome', 'Concept', 'Project')) WHERE reason IS NOT NULL)"""


def _near_sql() -> str:
    from quern.plans.curation import ORACLE_SQL as CURATION

    return f"""WITH RECURSIVE pairs AS (SELECT a, b FROM ({CURATION['near_duplicates_blocked']})), {DOCS},
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
classes AS (SELECT id, min(other) AS class FROM reach GROUP BY id),
ordered AS (SELECT class, doc_id, path, row_number() OVER (PARTITION BY class ORDER BY length(text) DESC, path) AS n, count(*) OVER (PARTITION BY class) AS size FROM docs JOIN classes ON id = doc_id)
SELECT class, doc_id, path, size AS n FROM ordered WHERE n = 1"""


_TITLED = "array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(stem, '[-_]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
ORACLE_SQL = {
    "path_filters": f"WITH {_FILES} SELECT {_BOILER} AS boilerplate, {_TRANS} AS translation, count(*) AS n, min(path) AS first_path FROM files GROUP BY 1, 2",
    "included_files": f"""WITH {_FILES}, sources AS (SELECT * FROM (VALUES (0, 1, []::VARCHAR[]), (1, 2, ['drafts/']), (2, 3, ['drafts/', 'install']), (3, 4, []), (4, 3, [])) t(source, tier, excludes))
SELECT source, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM files JOIN sources USING (source) WHERE tier <= 3 AND NOT {_BOILER} AND NOT {_TRANS} AND len(list_filter(excludes, lambda x: contains(path, x))) = 0 GROUP BY source""",
    "paths_within": f"WITH {_FILES} SELECT 'some' AS filter, count(*) AS n FROM files WHERE path IN (SELECT path FROM files WHERE id % 7 = 0) UNION ALL SELECT 'empty', count(*) FROM files",
    "path_owners": f"WITH {_FILES}, reg AS (SELECT * FROM (VALUES ('one', 'agents/one/'), ('two', 'agents/two/'), ('shared', 'shared/')) t(owner, p)) SELECT owner, count(*) AS n FROM files LEFT JOIN reg ON starts_with(path, p) GROUP BY owner",
    "stale_summaries": f"""WITH {_FILES}, f AS (SELECT path, max(mtime) AS mtime, count(*) AS n FROM files GROUP BY path)
SELECT path, mtime, CASE WHEN n % 2 = 0 THEN n % 3 > 0 ELSE true END AS stale FROM f""",
    "folder_entities": f"""WITH {_FILES}, rules AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}', '{t}', {c}::DOUBLE)" for k, (p, t, c) in enumerate(G.ENTITY_FOLDERS))}) t(rule, pattern, entity_type, confidence)),
hits AS (SELECT path, rule, entity_type, confidence, regexp_extract(path, pattern, 1) AS stem FROM files, rules WHERE id % 4 <> 0 AND regexp_matches(path, pattern)),
named AS (SELECT *, {_TITLED} AS name FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path, rule) AS place FROM named),
one AS (SELECT first(name ORDER BY path, rule) AS name, first(entity_type ORDER BY path, rule) AS entity_type, first(confidence ORDER BY path, rule) AS confidence,
  string_agg(path, '|' ORDER BY path) FILTER (place <= 5) AS source_docs, count(*) AS n_docs FROM placed GROUP BY lower(name))
SELECT *, row_number() OVER (ORDER BY confidence DESC, name) AS rank FROM one""",
    "note_targets": f"""WITH notes AS (SELECT conv_id, (['## 10:15 stand-up' || chr(10), 'Workflow: ', 'rule: ', 'how to ', 'Rationale: ', 'at 10.0.0.1 ', ''])[turn % 7 + 1] || text AS note FROM conversations),
kinds AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'shared' ELSE 'one' END AS agent, CASE {' '.join(f"WHEN regexp_matches(note, '{p}') THEN '{n}'" for n, p in C.NOTE_RULES)} ELSE 'unknown' END AS kind FROM notes)
SELECT kind, CASE WHEN kind = 'episodic' THEN CASE WHEN agent = 'shared' THEN 'builder' ELSE agent END || '/memory/2024-01-02.md' WHEN kind <> 'unknown' THEN 'knowledge/' || agent || '/' ||
  CASE kind WHEN 'procedural-rule' THEN 'rules.md' WHEN 'procedural-pattern' THEN 'patterns.md' WHEN 'semantic-decision' THEN 'decisions.md' ELSE 'facts.md' END END AS target, count(*) AS n FROM kinds GROUP BY 1, 2""",
    "phantom_entities": """SELECT p_partkey, lower(p_brand) = lower(split_part(p_type, ' ', 1)) OR regexp_matches('we sell ' || p_type || ' goods, ' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || 'X' END, '(?i)\\b' || regexp_escape(p_brand) || '\\b') AS kept FROM part""",
    "suggestion_filters": """WITH found AS (SELECT regexp_extract(o_orderpriority, '[^-]*$') AS surface, (['ORG', 'DATE', 'PERSON', 'MONEY', 'GPE'])[o_orderkey % 5 + 1] AS label FROM orders)
SELECT surface, CASE WHEN lower(surface) = 'urgent' THEN 'PRODUCT' ELSE label END AS label, CASE WHEN lower(surface) = 'urgent' THEN 'known' ELSE 'found' END AS source, count(*) AS n
FROM found WHERE lower(surface) NOT IN ('low', 'medium') AND (lower(surface) = 'urgent' OR label IN ('ORG', 'PERSON', 'GPE', 'PRODUCT', 'WORK_OF_ART')) GROUP BY 1, 2, 3""",
    "stub_faults": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'frontmatter_complete' END, CASE WHEN c_custkey % 5 = 0 THEN 'type_valid' END,
  CASE WHEN c_custkey % 40 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END < 20 THEN 'body_length' END, CASE WHEN c_custkey % 11 = 0 THEN 'no_boilerplate' END,
  CASE WHEN c_custkey % 2 <> 0 THEN 'has_relationships' END, CASE WHEN c_custkey % 7 = 0 THEN 'name_not_generic' END], lambda x: x IS NOT NULL), ',') AS faults FROM customer""",
    "curator_health": f"""{_G} SELECT label, count(*) AS n, count(*) FILTER (coalesce(trim(summary), '') = '') AS no_summary, count(*) FILTER (coalesce(trim(vault_path), '') = '') AS no_path, count(*) FILTER (length(name) * 10 > 90) AS stale FROM nodes GROUP BY label""",
    "prune_candidates": f"{_PRUNE} SELECT * FROM prune",
    "purge_log": f"""{_PRUNE} SELECT true AS dry_run, 'nodes' AS part, count(*) AS n FROM nodes UNION ALL SELECT true, 'edges', count(*) FROM edges UNION ALL SELECT true, 'log', count(*) FROM prune
UNION ALL SELECT false, 'nodes', count(*) FROM nodes WHERE id NOT IN (SELECT id FROM prune) UNION ALL SELECT false, 'edges', count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM prune) AND to_id NOT IN (SELECT id FROM prune)
UNION ALL SELECT false, 'log', count(*) FROM prune""",
    "label_counts": f"{_G} SELECT label, count(*) AS n FROM nodes GROUP BY ROLLUP (label)",
    "link_aliases": """SELECT p_brand AS target, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS aliases FROM part GROUP BY p_brand""",
    "linkable_notes": f"""WITH {_FILES}, p AS (SELECT CAST(id % 4 AS INT) AS form, lower((['a/archive/' || path, 'workspace/' || path, 'Workspace/x/memory/' || path, path])[id % 4 + 1]) AS low FROM files)
SELECT form, NOT contains(low, '/archive/') AND (NOT contains(low, 'workspace') OR contains(low, '/memory/')) AS eligible, count(*) AS n FROM p GROUP BY 1, 2""",
    "entity_ids_set": f"{_G} SELECT label, CASE WHEN length(name) % 3 = 0 THEN 'Q' || length(name) END AS wikidata_qid, count(*) AS n FROM nodes GROUP BY 1, 2",
    "find_entities": f"{_G} SELECT asked, min(id) AS id FROM (SELECT DISTINCT upper(name) AS asked FROM nodes WHERE label <> 'Technology') JOIN nodes ON lower(name) = lower(asked) GROUP BY asked",
    "link_targets": f"{_G} SELECT id, name, vault_path FROM nodes WHERE label IN ('Organisation', 'Person') AND vault_path IS NOT NULL",
    "canonical_of_near_copies": _near_sql(),
}
