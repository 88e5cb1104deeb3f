"""Many names found in many texts: word-aligned n-grams joined with a dictionary by equality, overlaps resolved, and first mentions linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import link_eligible
from quern.shared import cut

_IN = r"\p{L}\p{N}_"
#: A link, code, a word, or the beginning of a link or code that doesn't end; then what stands before the next one.
UNIT = rf"(?:\[\[[^\]\n]*+\]\]|```(?s:.*?)```|`[^`\n]*+`|[{_IN}]++|\[\[|`)"
BETWEEN = rf"(?:(?!\[\[|`)[^{_IN}])*+"
PIECE = f"(?:{UNIT}{BETWEEN})"


def plain_words(text: Column) -> Column:
    """Words in lower case with single spaces between; links and code are no words but themselves."""
    return F.btrim(F.lower(F.regexp_replace(text, rf"[^{_IN}\[\]`]++", " ")))


def dictionary(entities: DataFrame) -> DataFrame:
    """(entity_id, name, link, core, n): each name and alias of ``entities`` (id, name, aliases) with its words and the link it becomes.

    Names are trimmed; one without words is none. What stands before a name's first letter or digit isn't compared, what stands behind
    its last one is.
    """
    given = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = entities.where("name IS NOT NULL").select(F.col("id").alias("entity_id"), F.col("name").alias("_own"), F.explode(F.array_distinct(given)).alias("_name"))
    each = each.withColumn("name", F.regexp_replace(F.btrim("_name"), rf"^[^{_IN}]++", "")).withColumn("core", plain_words(F.col("name"))).where("core <> '' AND NOT core RLIKE '[\\\\[\\\\]`]'")
    link = F.when(F.col("_name") == F.col("_own"), F.concat(F.lit("[["), "_own", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "_own", F.lit("|"), "name", F.lit("]]")))
    return each.select("entity_id", "name", link.alias("link"), "core", F.size(F.split("core", " ")).alias("n")).distinct()


def name_mentions(notes: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, at, n, name): places of ``notes`` (doc_id, text) at which names of :func:`dictionary` stand, the longest of those that overlap.

    ``at`` counts words, links and code from 0; mentions inside links or code are none. A mention has the name's own spelling and is whole
    words. Of overlapping mentions each is dropped that overlaps a longer one, or one as long that begins before. Texts are
    read word by word, each with the words behind it that the longest name needs; those that no name begins with go first, then
    stretches of the lengths of names with that first word are joined with the names by equality.
    """
    names = cut(names)
    most = names.agg(F.max("n")).first()[0] or 1
    stretch = F.regexp_extract_all("text", F.lit(f"(?=({PIECE}{{1,{most}}})){PIECE}"), F.lit(1))
    words = notes.select("doc_id", F.posexplode(stretch).alias("at", "_raw")).withColumn("_words", plain_words(F.col("_raw")))
    begins = names.select(F.substring_index("core", " ", 1).alias("_first"), "n").distinct()
    tried = words.withColumn("_first", F.substring_index("_words", " ", 1)).join(begins, "_first").withColumn("core", F.call_function("substring_index", F.col("_words"), F.lit(" "), F.col("n")))
    spelled = names.select("core", "n", "name").distinct()
    found = tried.join(spelled, ["core", "n"]).where(F.startswith("_raw", "name")).select("doc_id", "at", "n", "name")
    near = Window.partitionBy("doc_id").orderBy("at").rangeBetween(1 - most, most - 1)
    wins = lambda x: (x["at"] < F.col("at") + F.col("n")) & (F.col("at") < x["at"] + x["n"]) & ((x["n"] > F.col("n")) | ((x["n"] == F.col("n")) & (x["at"] < F.col("at"))))
    places = cut(found).withColumn("_near", F.collect_set(F.struct("at", "n")).over(near))
    return places.where(~F.exists("_near", wins)).drop("_near")


def first_mentions(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, at, n, name, entity_id, link): the first mention of each entity (id, name, aliases, vault_path) in each note (doc_id, path, text).

    Left out are notes that may not be linked, an entity's own page or a page in its folder, and entities that the note links to
    already. A spelling that several entities share stands for the smallest id among those left.
    """
    names = cut(dictionary(entities))
    allowed = notes.where(link_eligible(F.col("path")))
    mentions = name_mentions(allowed, names).join(names.select("name", "entity_id", "link"), "name")
    own = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("_name"), F.col("vault_path").alias("_page"))
    known = mentions.join(own, "entity_id").join(allowed.select("doc_id", "path"), "doc_id")
    in_folder = F.endswith("_page", F.lit("/")) & F.startswith("path", "_page")
    known = known.where(~F.coalesce((F.col("path") == F.col("_page")) | in_folder, F.lit(False)))
    linked = allowed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]\|\n]+)"), F.lit(1))).alias("_link")).select("doc_id", F.lower(F.btrim("_link")).alias("_name")).distinct()
    left = known.join(linked, ["doc_id", "_name"], "left_anti")
    chosen = left.groupBy("doc_id", "at", "n", "name").agg(F.min(F.struct("entity_id", "link")).alias("_e"))
    first = F.min(F.struct("at", "n", "name", F.col("_e.link").alias("link"))).alias("_m")
    return chosen.groupBy("doc_id", F.col("_e.entity_id").alias("entity_id")).agg(first).select("doc_id", "_m.*", "entity_id")


def linked_notes(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """The columns of ``notes``, one row a doc_id, with :func:`first_mentions` as links in ``text``, then ``links``, the entities linked; other notes stay as they are."""
    found = first_mentions(notes, entities).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "name", "link"))).alias("_m"), F.sort_array(F.collect_set("entity_id")).alias("links"))
    cut_up = notes.join(found, "doc_id", "left").withColumn("_pieces", F.when(F.col("_m").isNotNull(), F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))))
    part = lambda a, b: F.array_join(F.slice("_pieces", a + 1, b - a), "")

    def linked(m: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(0)).otherwise(F.get("_m", k - 1)["at"] + F.get("_m", k - 1)["n"])
        behind = F.substring(part(m["at"], m["at"] + m["n"]), F.length(m["name"]) + 1, F.length("text"))
        return F.concat(part(before, m["at"]), m["link"], behind)

    head = F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(F.array_join("_pieces", "")))
    last = F.element_at("_m", -1)
    new = F.concat(head, F.array_join(F.transform("_m", linked), ""), part(last["at"] + last["n"], F.size("_pieces")))
    return cut_up.select(*[F.when(F.col("_m").isNull(), F.col("text")).otherwise(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in notes.columns], F.coalesce("links", F.array().cast("array<string>")).alias("links"))


#: Nodes with a page that a graph must have to be asked for names (fixed value).
ENOUGH = 5


def entities_to_link(nodes: DataFrame, rows: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(id, name, aliases, vault_path): organisations and persons of the graph (id, label, name, aliases, vault_path) that have a page, or if there are fewer than ``enough`` those of entity tables (name, aliases, page, fault)."""
    paged = nodes.where(F.col("label").isin("Organisation", "Person") & (F.coalesce("vault_path", F.lit("")) != ""))
    if paged.limit(enough).count() == enough:
        return paged.select("id", "name", "aliases", "vault_path")
    return rows.where("fault IS NULL").select(F.col("name").alias("id"), "name", "aliases", F.col("page").alias("vault_path"))
