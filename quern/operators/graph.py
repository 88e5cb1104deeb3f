"""Entities, links between them, and links in notes, as tables of nodes and edges."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import components
from quern.shared import cut, numbered, small

#: Edits in 100 letters that similar slugs may differ in, and the letters from which slugs are compared by length alone.
EDITS, LONG = 15, 200
#: Labels of nodes and kinds of edges that a graph may hold (fixed values).
LABELS = "Document Organisation Person Outcome Concept Framework Technology Publication".split()
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, row_count, in_degree): the rows of the outer join, which is 1 for a node that nothing mentions, and the true count."""
    mentions = edges.where(F.col("kind") == "MENTIONS").groupBy("to_id").agg(F.count("*").alias("n"))
    joined = nodes.select("id").join(mentions, F.col("id") == F.col("to_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("id", F.greatest(n, F.lit(1)).alias("row_count"), n.alias("in_degree"))


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(seed, id, hop): what is reached from each seed in at most ``most`` steps along either direction, at its first hop."""
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"))
    last = seen
    for hop in range(1, most + 1):
        reached = last.join(both, F.col("id") == F.col("from_id")).select("seed", F.col("to_id").alias("id")).distinct()
        last = reached.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(last)
    return seen.where(F.col("hop") > 0)


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``ids``, and edges without any end among them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    left = edges.join(gone, F.col("from_id") == F.col("_gone"), "left_anti").join(gone, F.col("to_id") == F.col("_gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti"), left


def referential(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends exist; a source labelled Document need not, as it is made with its edge."""
    known = nodes.select(F.col("id").alias("_known"))
    to = edges.join(known, F.col("to_id") == F.col("_known"), "left_semi")
    free = F.col("from_label") == "Document"
    return to.where(free).unionByName(to.where(~free).join(known, F.col("from_id") == F.col("_known"), "left_semi"))


def valid_edges(edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges with known labels, kind and ends, and the rest with the reason; a null label or kind is unknown."""
    known = lambda c, names: F.coalesce(F.col(c).isin(list(names)), F.lit(False))
    reason = (
        F.when(F.coalesce(F.btrim("from_id"), F.lit("")) == "", "no from_id").when(F.coalesce(F.btrim("to_id"), F.lit("")) == "", "no to_id")
        .when(~known("from_label", LABELS) | ~known("to_label", LABELS), "unknown label").when(~known("kind", kinds), "unknown kind")
    )
    marked = edges.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def health(nodes: DataFrame, short: int = 50) -> DataFrame:
    """Counts by label, of nodes without a path, and of those with a missing or short summary."""
    return nodes.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.btrim("vault_path"), F.lit("")) == "").alias("no_path"),
        F.count_if(F.col("summary").isNull() | (F.length("summary") < short)).alias("short_summary"),
    )


def _pieces(slug: str) -> Iterator[tuple[bool, str]]:
    """(of the longer, key): a slug and any longer one as similar share a key, once of each side.

    A longer slug of n letters is cut into one piece more than the edits it may have, so one piece is left whole; the
    shorter one offers its parts wherever such a piece can lie. Slugs of more than LONG letters meet by length alone.
    """
    m, step = len(slug), math.log(100 / (100 - EDITS))
    if m > LONG:
        yield True, f"{int(math.log(m) / step)}"
    n = m
    while n - n * EDITS // 100 <= m and n <= LONG:
        edits, less = n * EDITS // 100, n - m
        slack = (edits - less) // 2
        for k in range(edits + 1 if edits else 0):
            start, end = k * n // (edits + 1), (k + 1) * n // (edits + 1)
            if n == m:
                yield True, f"{n} {k} {slug[start:end]}"
            for at in range(max(0, start - less - slack), min(start + slack, m - (end - start)) + 1):
                yield False, f"{n} {k} {slug[at : at + end - start]}"
        n += 1
    if n > LONG:
        for more in range(3):
            yield False, f"{int(math.log(m) / step) + more}"


def similar_slugs(slugs: DataFrame) -> DataFrame:
    """(entity_type, slug, root) of slugs with similar ones in their type: the smallest slug over any number of steps.

    Similar slugs differ in at most EDITS edits of 100 letters of the longer one and hold the same numbers, as names that
    count (``iso-27001``, ``iso-27002``) are not one entity.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entity_type, slug, numbers in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "slug", "numbers")), strict=True):
                found = sorted(set(_pieces(slug)))
                n = len(found)
                columns = [[entity_type] * n, [slug] * n, [numbers] * n]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns), pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.string())],
                                                 ["entity_type", "slug", "numbers", "longer", "key"])

    known = slugs.where(F.col("entity_type").isNotNull() & (F.col("slug") != "")).distinct()
    numbers = F.array_join(F.regexp_extract_all("slug", F.lit("[0-9]+"), F.lit(0)), " ")
    pieces = known.select("entity_type", "slug", numbers.alias("numbers")).mapInArrow(keys, "entity_type string, slug string, numbers string, longer boolean, key string")
    longer = pieces.where("longer").drop("longer")
    shorter = pieces.where(~F.col("longer")).drop("longer").withColumnRenamed("slug", "other")
    pairs = longer.join(shorter, ["entity_type", "numbers", "key"]).where(F.col("slug") != F.col("other")).select("entity_type", "slug", "other").distinct()
    near = F.levenshtein("slug", "other") <= F.floor(F.greatest(F.length("slug"), F.length("other")) * F.lit(EDITS) / 100)
    number = lambda c: F.xxhash64("entity_type", c)
    linked = components(pairs.where(near).select(number("slug").alias("a"), number("other").alias("b"))).withColumnRenamed("root", "_root")
    held = known.withColumn("id", number("slug")).join(linked, "id")
    roots = held.groupBy("entity_type", "_root").agg(F.min("slug").alias("root"))
    return held.join(roots, ["entity_type", "_root"]).select("entity_type", "slug", "root")


def _slugged(entities: DataFrame, slug: Column) -> DataFrame:
    """Entities of a name with their slug, or the root of all slugs similar to it."""
    named = entities.where(F.btrim("name") != "").withColumn("slug", slug)
    roots = similar_slugs(named.select("entity_type", "slug"))
    return named.join(roots, ["entity_type", "slug"], "left").withColumn("slug", F.coalesce("root", "slug")).drop("root")


def resolve(entities: DataFrame, slug: Column) -> DataFrame:
    """One row for each type and slug of names, similar slugs being one; blank names go.

    It has the first name, all names and given ``aliases``, the number of documents, the largest confidence and, if
    given, all ``domains`` (both arrays). Documents are counted over (type, slug, document) first, so no row holds the
    documents of a common entity.
    """
    every = lambda c: F.flatten(F.collect_set(c))
    given = [x for x in ("aliases", "domains") if x in entities.columns]
    by_doc = _slugged(entities, slug).groupBy("entity_type", "slug", "source_doc").agg(
        F.collect_set("name").alias("names"), F.max("confidence").alias("confidence"), *(F.array_distinct(every(x)).alias(x) for x in given))
    all_names = F.concat(every("names"), every("aliases")) if "aliases" in given else every("names")
    return by_doc.groupBy("entity_type", "slug").agg(
        F.min(F.array_min("names")).alias("name"), F.sort_array(F.array_distinct(all_names)).alias("aliases"),
        F.count("source_doc").alias("n_docs"), F.max("confidence").alias("confidence"), *(F.sort_array(F.array_distinct(every(x))).alias(x) for x in given if x == "domains"),
    )


def entity_documents(entities: DataFrame, slug: Column) -> DataFrame:
    """(entity_type, slug, source_doc): all documents of each entity, each once."""
    return _slugged(entities, slug).where(F.col("source_doc").isNotNull()).select("entity_type", "slug", "source_doc").distinct()


def written_nodes(resolved: DataFrame, documents: DataFrame, most: int = 20) -> DataFrame:
    """``resolved`` with ``source_docs``, the first ``most`` documents, for a list of nodes that people read."""
    place = F.row_number().over(Window.partitionBy("entity_type", "slug").orderBy("source_doc"))
    shown = documents.withColumn("_place", place).where(F.col("_place") <= most).groupBy("entity_type", "slug").agg(F.sort_array(F.collect_list("source_doc")).alias("source_docs"))
    return resolved.join(shown, ["entity_type", "slug"], "left").withColumn("source_docs", F.coalesce("source_docs", F.array()))


def emit_edges(relations: DataFrame, names: DataFrame, slug) -> DataFrame:
    """(from_id, to_id, kind): ends by name, else by slug; blank ends go, of equal edges the first document stays.

    ``names`` is (name, id), of each name the smallest id.
    """
    ids = names.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_id"))
    out = relations
    for end in ("from", "to"):
        out = (
            out.join(ids, F.lower(f"{end}_name") == F.col("_name"), "left")
            .withColumn(f"{end}_id", F.coalesce("_id", slug(F.col(f"{end}_name")))).drop("_id", "_name")
        )
    kept = out.where((F.coalesce("from_id", F.lit("")) != "") & (F.coalesce("to_id", F.lit("")) != ""))
    return kept.groupBy("from_id", "to_id", "kind").agg(F.min("source_doc").alias("source_doc"))


def mentions(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, entity_id): ``[[links]]`` of notes to known entities, each once."""
    found = notes.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("name"))
    known = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("_name"))
    return found.join(known, F.lower(F.btrim("name")) == F.col("_name")).select("doc_id", "entity_id").distinct()


def mention_counts(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, n): how many notes link to each known entity that one links to; the count of :func:`mentions` without its rows.

    Many entities may share a name, so notes are counted by name (or by the set of names, of an entity with several) and only
    those counts meet the entities.
    """
    named = cut(entities.where("name IS NOT NULL").groupBy(F.col("id").alias("entity_id")).agg(F.sort_array(F.collect_set(F.lower("name"))).alias("_names")))
    sets = cut(named.select("_names").distinct().withColumn("_set", F.monotonically_increasing_id()))
    name_of = small(sets.select("_set", F.explode("_names").alias("_name")))
    found = notes.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("name"))
    met = found.select("doc_id", F.lower(F.btrim("name")).alias("_name")).join(name_of, "_name")
    counts = cut(met.select("_set", "doc_id").distinct().groupBy("_set").agg(F.count("doc_id").alias("n")))
    return named.join(small(sets.join(small(counts), "_set")), "_names").select("entity_id", "n")


def inject_links(text: Column, names: Column) -> Column:
    """The first mention of each name as a ``[[link]]``, unless the text links to it already or has no such word."""

    def linked(t: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(r"(?s)\A(.*?)\b\Q"), name, F.lit(r"\E\b"))
        before = F.call_function("regexp_extract", t, pattern, F.lit(1))
        hit = F.rlike(t, pattern) & ~F.contains(t, F.concat(F.lit("[["), name))
        rest = F.substring(t, F.length(before) + F.length(name) + 1, F.length(t))
        return F.when(hit, F.concat(before, F.lit("[["), name, F.lit("]]"), rest)).otherwise(t)

    return F.aggregate(names, text, linked)


#: Folders whose files name entities, their type and how sure that is, in the order in which they are tried (fixed values).
ENTITY_FOLDERS = [
    (r"(?i)(?:^|/)(?:clients?|organisations?|companies|vendors?|partners?)/([^/]+?)(?:\.md)?$", "Organisation", 0.85),
    (r"(?i)(?:^|/)(?:people|persons?|contacts?|team|stakeholders?)/([^/]+?)(?:\.md)?$", "Person", 0.85),
    (r"(?i)(?:^|/)(?:frameworks?|methods?|methodologies|patterns?)/([^/]+?)(?:\.md)?$", "Framework", 0.75),
]


def shown_name(stem: Column) -> Column:
    """Words of a file's name with a capital first; words all in capitals stay."""
    words = F.filter(F.split(F.regexp_replace(stem, "[-_]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1), w).otherwise(F.initcap(w))), " ")


def folder_entities(documents: DataFrame) -> DataFrame:
    """(name, entity_type, confidence, source_docs, rank): entities that paths of active documents name.

    Names are one in any case; the first path decides on type and spelling. ``source_docs`` are the first five of their
    ``n_docs`` paths.
    """
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_extract("path", p, 1).alias("stem"), F.lit(t).alias("entity_type"), F.lit(c).alias("confidence"))
                      for k, (p, t, c) in enumerate(ENTITY_FOLDERS)])
    each = documents.where(F.col("active") == 1).select("path", F.inline(F.filter(found, lambda x: x["stem"] != "")))
    each = each.withColumn("name", shown_name(F.col("stem"))).withColumn("_key", F.lower("name"))
    first = F.struct("path", "rule")
    few = each.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy("path", "rule"))).where(F.col("_place") <= 5)
    shown = few.groupBy("_key").agg(F.array_join(F.sort_array(F.collect_list("path")), "|").alias("source_docs"))
    out = each.groupBy("_key").agg(
        F.min_by("name", first).alias("name"), F.min_by("entity_type", first).alias("entity_type"), F.min_by("confidence", first).alias("confidence"), F.count("*").alias("n_docs"),
    ).join(shown, "_key").drop("_key")
    return numbered(out.withColumn("_down", -F.col("confidence")), "_down", "name").drop("_down")


def named_in(name: Column, surface: Column, text: Column) -> Column:
    """Whether a stored entity is meant: its name is the surface form, or stands in the text as whole words."""
    inside = lambda c: c.rlike(r"^[\p{L}\p{N}_]")
    left = F.when(inside(name), r"\b").otherwise(r"(?:^|(?<=\W))")
    right = F.when(inside(F.reverse(name)), r"\b").otherwise(r"(?:$|(?=\W))")
    whole = F.rlike(text, F.concat(F.lit("(?i)"), left, F.lit(r"\Q"), name, F.lit(r"\E"), right))
    return (F.btrim(name) != "") & ((F.lower(name) == F.lower(surface)) | whole)


#: Kinds of named things that may be entities (fixed values).
NER_LABELS = "ORG PERSON GPE PRODUCT WORK_OF_ART".split()


def suggestions(found: DataFrame, allowed: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(doc_id, surface, label, source): what a recogniser found, without role phrases and other labels, and known names.

    ``found`` is (doc_id, surface, label, text); ``allowed`` (name, label) known names, which stay whatever their label.
    """
    known = allowed.select(F.lower("name").alias("_name"), F.col("label").alias("_label"))
    plain = found.where(~F.lower("surface").isin([x.lower() for x in roles]))
    marked = plain.join(known, F.lower("surface") == F.col("_name"), "left")
    kept = marked.where(F.col("_name").isNotNull() | F.col("label").isin(NER_LABELS))
    return kept.select("doc_id", "surface", F.coalesce("_label", "label").alias("label"), F.when(F.col("_name").isNotNull(), "known").otherwise("found").alias("source"))


STUB_TYPES = "person organisation concept project decision".split()
STUB_FIELDS = "type name entity-id created".split()


def stub_faults(fields: Column, content: Column, body: Column, stop_names: Sequence[str] = ()) -> Column:
    """What is wrong with an entity's page, in order: an array of names of checks, empty for a good one."""
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: F.btrim(x) != ""))
    name = F.btrim(F.coalesce(F.try_element_at(fields, F.lit("name")), F.lit("")))
    checks = [
        ("frontmatter_complete", F.size(F.array_except(F.array(*[F.lit(x) for x in STUB_FIELDS]), F.map_keys(fields))) > 0),
        ("type_valid", ~F.coalesce(F.btrim(F.try_element_at(fields, F.lit("type"))), F.lit("")).isin(STUB_TYPES)),
        ("body_length", lines < 20),
        ("no_boilerplate", content.contains("Auto-generated entity") | content.contains("Needs manual review") | content.rlike(r"appears in \d+ (vault )?documents")),
        ("has_relationships", ~(body.contains("## Relationships") | body.contains("## Related"))),
        ("name_not_generic", (name == "") | F.lower(name).isin([x.lower() for x in stop_names])),
    ]
    return F.array_compact(F.array(*[F.when(bad, n) for n, bad in checks]))


def curator_health(nodes: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """By label: nodes, those without a summary, without a path, and not seen for more than ``days``."""
    return nodes.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.btrim("summary"), F.lit("")) == "").alias("no_summary"),
        F.count_if(F.coalesce(F.btrim("vault_path"), F.lit("")) == "").alias("no_path"), F.count_if(F.datediff(as_of, "last_seen") > days).alias("stale"),
    )


def prune_reasons(nodes: DataFrame, files: DataFrame, labels: Sequence[str] = ("Organisation", "Person", "Outcome", "Concept", "Project")) -> DataFrame:
    """(id, name, label, reason) of nodes to delete: their file is missing, or they have neither page nor summary."""
    there = files.select(F.col("path").alias("_path")).distinct()
    has_path = F.coalesce(F.col("vault_path"), F.lit("")) != ""
    joined = nodes.where(F.col("label").isin(list(labels))).join(there, F.col("vault_path") == F.col("_path"), "left")
    reason = F.when(has_path & F.col("_path").isNull(), "file_missing").when(~has_path & (F.coalesce("summary", F.lit("")) == ""), "no_stub_no_summary")
    return joined.select("id", "name", "label", reason.alias("reason")).where(F.col("reason").isNotNull())


def purge(nodes: DataFrame, edges: DataFrame, audit: DataFrame, dry_run: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes left, edges left, log): deletes what an audit (id, reason) names; a dry run deletes nothing."""
    log = audit.select("id", "reason", F.lit("dry run" if dry_run else "deleted").alias("status"))
    return (nodes, edges, log) if dry_run else (*detach_delete(nodes, edges, audit), log)


def count_by_label(nodes: DataFrame) -> DataFrame:
    """(label, n), with the total under a null label."""
    return nodes.rollup("label").agg(F.count("*").alias("n"))


def aliases_of(notes: DataFrame) -> DataFrame:
    """(target, aliases): what ``[[target|display]]`` links call their targets, each once."""
    pairs = F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+\|[^\]|]+)\]\]"), F.lit(1))
    each = notes.select(F.explode(pairs).alias("p")).select(F.btrim(F.substring_index("p", "|", 1)).alias("target"), F.btrim(F.substring_index("p", "|", -1)).alias("alias")).distinct()
    return each.where(F.lower("target") != F.lower("alias")).groupBy("target").agg(F.array_join(F.sort_array(F.collect_list("alias")), "|").alias("aliases"))


def link_eligible(path: Column) -> Column:
    """Notes that may be linked: not archived, and of a workspace only its memory."""
    low = F.lower(path)
    return ~F.contains(low, F.lit("/archive/")) & (~F.contains(low, F.lit("workspace")) | F.contains(low, F.lit("/memory/")))


def set_field(nodes: DataFrame, updates: DataFrame, field: str) -> DataFrame:
    """``nodes`` with ``field`` taken from ``updates`` (id, field) where they have the id."""
    new = updates.select("id", F.col(field).alias("_new"))
    old = F.col(field) if field in nodes.columns else F.lit(None)
    return nodes.join(new, "id", "left").withColumn(field, F.coalesce("_new", old)).drop("_new")
