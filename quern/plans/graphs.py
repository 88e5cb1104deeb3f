"""Queries over entities, links and graph health, with their SQL. Nodes and edges are made from the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import slugify
from quern.operators import dictionary as D
from quern.operators import graph as G
from quern.plans.tables import table


def nodes(spark, sf_dir):
    """Customers, suppliers and parts as persons, organisations and technologies."""
    c, s, p = (table(spark, sf_dir, x) for x in ("customer", "supplier", "part"))
    path = lambda k, folder: F.when(k % 4 != 0, F.concat(F.lit(f"{folder}/"), k.cast("string"), F.lit(".md")))
    return (
        c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Person").alias("label"), F.col("c_name").alias("name"), path(F.col("c_custkey"), "people").alias("vault_path"),
                 F.when(F.col("c_custkey") % 3 != 0, F.repeat(F.concat("c_mktsegment", F.lit(" ")), 1 + F.col("c_custkey").cast("int") % 9)).alias("summary"))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Organisation").alias("label"), F.col("s_name").alias("name"), path(F.col("s_suppkey"), "orgs").alias("vault_path"), F.lit(None).cast("string").alias("summary")))
        .unionByName(p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Technology").alias("label"), F.col("p_name").alias("name"), path(F.col("p_partkey"), "tech").alias("vault_path"), F.col("p_type").alias("summary")))
    )


def edges(spark, sf_dir):
    """Orders mention parts; customers know the suppliers of their nation's key as number."""
    l, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    return (
        l.select(F.concat(F.lit("o"), "l_orderkey").alias("from_id"), F.lit("Document").alias("from_label"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.lit("Technology").alias("to_label"), F.lit("MENTIONS").alias("kind"))
        .unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("from_id"), F.lit("Person").alias("from_label"), F.concat(F.lit("s"), "c_nationkey").alias("to_id"), F.lit("Organisation").alias("to_label"), F.lit("WORKS_AT").alias("kind")))
    )


_G = """WITH nodes AS (
  SELECT 'c' || c_custkey AS id, 'Person' AS label, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'people/' || c_custkey || '.md' END AS vault_path,
         CASE WHEN c_custkey % 3 <> 0 THEN repeat(c_mktsegment || ' ', CAST(1 + c_custkey % 9 AS BIGINT)) END AS summary FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Organisation', s_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'orgs/' || s_suppkey || '.md' END, NULL FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'Technology', p_name, CASE WHEN p_partkey % 4 <> 0 THEN 'tech/' || p_partkey || '.md' END, p_type FROM part),
edges AS (
  SELECT 'o' || l_orderkey AS from_id, 'Document' AS from_label, 'p' || l_partkey AS to_id, 'Technology' AS to_label, 'MENTIONS' AS kind FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 'Person', 's' || c_nationkey, 'Organisation', 'WORKS_AT' FROM customer)"""


def entity_in_degree(spark, sf_dir):
    return G.in_degrees(nodes(spark, sf_dir).where(F.col("vault_path").isNotNull()), edges(spark, sf_dir))


def graph_two_hop(spark, sf_dir):
    """What is two steps or fewer from each supplier."""
    seeds = nodes(spark, sf_dir).where(F.col("label") == "Organisation")
    return G.hops(edges(spark, sf_dir).where(F.col("kind") == "WORKS_AT"), seeds)


def detach_delete(spark, sf_dir):
    gone = nodes(spark, sf_dir).where(F.col("vault_path").isNull() & F.col("summary").isNull()).select("id")
    left, links = G.detach_delete(nodes(spark, sf_dir), edges(spark, sf_dir), gone)
    return left.groupBy("label").agg(F.count("*").alias("n")).unionByName(links.groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n")))


def edge_referential(spark, sf_dir):
    return G.referential(nodes(spark, sf_dir), edges(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def store_health(spark, sf_dir):
    return G.health(nodes(spark, sf_dir))


def kind_pivot(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("from_label").pivot("kind", ["MENTIONS", "WORKS_AT"]).agg(F.count(F.lit(1)))


def entity_resolution(spark, sf_dir):
    """Parts' brands as entities that several documents (part keys) name."""
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))).alias("name"), F.lit("Organisation").alias("entity_type"),
        F.col("p_partkey").alias("source_doc"), (F.col("p_size") / 50).alias("confidence"))
    found = G.resolve(raw, slugify(F.col("name")))
    return found.select("entity_type", "slug", "name", F.array_join("aliases", "|").alias("aliases"), "n_docs", F.round("confidence", 6).alias("confidence"))


def entity_edges(spark, sf_dir):
    """Parts to their brands and types, by name where a node has it and by slug else."""
    p = table(spark, sf_dir, "part")
    relations = p.select(F.col("p_name").alias("from_name"), F.col("p_brand").alias("to_name"), F.lit("MADE_BY").alias("kind"), F.col("p_partkey").alias("source_doc"))
    return G.emit_edges(relations, nodes(spark, sf_dir).select("name", "id"), slugify)


def wikilink_mentions(spark, sf_dir):
    """How many notes link to each part, by name, in two forms."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    note = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("see [["), "p_name", F.lit("]] and [[Nothing]]"))).otherwise(F.concat(F.lit("see [["), F.upper("p_name"), F.lit("|this]]")))
    notes = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), note.alias("text"))
    return G.mention_counts(notes, nodes(spark, sf_dir).where(F.col("label") == "Technology"))


def wikilink_injection(spark, sf_dir):
    """The first mention of two common words of each document as links."""
    docs = table(spark, sf_dir, "documents")
    linked = G.inject_links(F.col("text"), F.array(F.lit("the"), F.lit("and")))
    return docs.select("doc_id", F.sha2(linked, 256).alias("linked_hash"))


def named_entities(spark, sf_dir):
    """Customers, and the names of parts and their second words, as entities with a page each."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    page = lambda folder, k: F.concat(F.lit(folder), k.cast("string"), F.lit(".md")).alias("vault_path")
    none = F.lit(None).cast("array<string>").alias("aliases")
    word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    part = lambda name, tag: p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit(tag), "k").alias("id"), "name", none, page("tech/", F.col("k")))
    people = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), none, page("people/", F.col("c_custkey")))
    return people.unionByName(part(F.col("p_name"), "p")).unionByName(part(word, "w").where("name <> ''"))


def order_notes(spark, sf_dir):
    """A note of each order: who asked for which parts; a third link the first part, a quarter are their customer's page, another archived."""
    l, p, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "part", "orders", "customer"))
    lines = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("_l"))
    names = F.transform("_l", lambda x: x["p_name"])
    k = F.col("o_orderkey")
    text = F.concat("c_name", F.lit(" asked for a "), F.array_join(names, ", a "), F.when(k % 3 == 0, F.concat(F.lit("; see [["), F.get(names, F.lit(0)), F.lit("]]."))).otherwise(F.lit(".")))
    path = F.when(k % 4 == 0, F.concat(F.lit("people/"), F.col("o_custkey").cast("string"), F.lit(".md"))).when(k % 4 == 1, F.lit("a/archive/x.md")).otherwise(F.concat(F.lit("notes/"), k.cast("string"), F.lit(".md")))
    rows = o.join(lines, k == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(k.alias("doc_id"), path.alias("path"), text.alias("text"))


def named_in_notes(spark, sf_dir):
    """How often each name of an entity is mentioned in notes, the longest of those that overlap."""
    found = D.name_mentions(order_notes(spark, sf_dir), D.dictionary(named_entities(spark, sf_dir)))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("notes"))


def note_links(spark, sf_dir):
    """Notes with the first mention of each entity as a link."""
    return D.linked_notes(order_notes(spark, sf_dir), named_entities(spark, sf_dir)).select("doc_id", "links", F.sha2("text", 256).alias("linked_hash"))


QUERIES = {
    "named_in_notes": named_in_notes, "note_links": note_links,
    "entity_in_degree": entity_in_degree, "graph_two_hop": graph_two_hop, "detach_delete": detach_delete, "edge_referential": edge_referential,
    "store_health": store_health, "kind_pivot": kind_pivot, "entity_resolution": entity_resolution, "entity_edges": entity_edges,
    "wikilink_mentions": wikilink_mentions, "wikilink_injection": wikilink_injection,
}
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
ORACLE_SQL = {
    "entity_in_degree": f"""{_G}
SELECT id, count(*) AS row_count, count(to_id) AS in_degree FROM nodes LEFT JOIN (SELECT to_id FROM edges WHERE kind = 'MENTIONS') ON to_id = id WHERE vault_path IS NOT NULL GROUP BY id""",
    "graph_two_hop": f"""{_G},
both_ways AS (SELECT from_id, to_id FROM edges WHERE kind = 'WORKS_AT' UNION SELECT to_id, from_id FROM edges WHERE kind = 'WORKS_AT'),
one AS (SELECT DISTINCT n.id AS seed, b.to_id AS id FROM nodes n JOIN both_ways b ON b.from_id = n.id WHERE label = 'Organisation'),
two AS (SELECT DISTINCT seed, b.to_id AS id FROM one JOIN both_ways b ON b.from_id = one.id WHERE b.to_id <> seed)
SELECT seed, id, 1 AS hop FROM one UNION ALL SELECT seed, id, 2 FROM two ANTI JOIN one USING (seed, id)""",
    "detach_delete": f"""{_G}, gone AS (SELECT id FROM nodes WHERE vault_path IS NULL AND summary IS NULL)
SELECT label, count(*) AS n FROM nodes ANTI JOIN gone USING (id) GROUP BY label
UNION ALL SELECT kind, count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone) GROUP BY kind""",
    "edge_referential": f"""{_G} SELECT kind, count(*) AS n FROM edges
WHERE to_id IN (SELECT id FROM nodes) AND (from_label = 'Document' OR from_id IN (SELECT id FROM nodes)) GROUP BY kind""",
    "store_health": f"""{_G} SELECT label, count(*) AS n, count(*) FILTER (coalesce(trim(vault_path), '') = '') AS no_path,
count(*) FILTER (summary IS NULL OR length(summary) < 50) AS short_summary FROM nodes GROUP BY label""",
    "kind_pivot": f"""{_G} SELECT from_label, nullif(count(*) FILTER (kind = 'MENTIONS'), 0) AS "MENTIONS", nullif(count(*) FILTER (kind = 'WORKS_AT'), 0) AS "WORKS_AT" FROM edges GROUP BY from_label""",
    "entity_resolution": f"""WITH raw AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name, p_partkey, p_size / 50 AS confidence FROM part)
SELECT 'Organisation' AS entity_type, {_SLUG.format('name')} AS slug, min(name) AS name, array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases,
  count(DISTINCT p_partkey) AS n_docs, round(max(confidence), 6) AS confidence FROM raw GROUP BY 2""",
    "entity_edges": f"""{_G}, ids AS (SELECT lower(name) AS n, min(id) AS id FROM nodes GROUP BY 1)
SELECT coalesce(a.id, {_SLUG.format('p_name')}) AS from_id, coalesce(b.id, {_SLUG.format('p_brand')}) AS to_id, 'MADE_BY' AS kind, min(p_partkey) AS source_doc
FROM part LEFT JOIN ids a ON a.n = lower(p_name) LEFT JOIN ids b ON b.n = lower(p_brand) GROUP BY 1, 2""",
    "named_in_notes": """WITH words AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line, p_name, split_part(p_name, ' ', 2) AS word FROM lineitem JOIN part ON l_partkey = p_partkey),
said AS (
  SELECT doc_id, p_name AS name FROM words UNION ALL
  SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey))
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS notes FROM said GROUP BY name""",
    "wikilink_mentions": """SELECT 'p' || q.p_partkey AS entity_id, count(DISTINCT l_orderkey) AS n
FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN part q ON lower(q.p_name) = lower(p.p_name) GROUP BY 1""",
}
