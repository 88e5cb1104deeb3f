"""Queries over ingest, curation, text functions, dates and rule classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import corpus as C
from quern.plans.tables import DOCS, documents, queries, table
from quern.shared import new_path, small, spread
from quern.streaming.store import Store


def _snapshots(spark, sf_dir):
    """Two scans of the documents: the later lacks some, has others anew, and holds some texts changed."""
    docs = documents(spark, sf_dir).select("doc_id", "collection", "path", "hash")
    known = docs.where(F.col("doc_id") % 5 != 0)
    seen = docs.where(F.col("doc_id") % 7 != 0).withColumn("hash", F.when(F.col("doc_id") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return known, seen


_SNAP = f"""WITH {DOCS},
known AS (SELECT collection, path, hash FROM docs WHERE doc_id % 5 <> 0),
seen AS (SELECT collection, path, CASE WHEN doc_id % 11 = 0 THEN hash || 'x' ELSE hash END AS hash FROM docs WHERE doc_id % 7 <> 0),
joined AS (
  SELECT collection, path, k.hash AS old_hash, s.hash AS new_hash,
         CASE WHEN s.hash IS NULL THEN 'removed' WHEN k.hash IS NULL THEN 'new' WHEN k.hash <> s.hash THEN 'updated' ELSE 'unchanged' END AS action
  FROM known k FULL JOIN seen s USING (collection, path)),
stay AS (SELECT DISTINCT old_hash AS h FROM joined WHERE action = 'unchanged'),
diff AS (
  SELECT collection, path, coalesce(new_hash, old_hash) AS hash,
         CASE WHEN action = 'new' AND h IS NOT NULL THEN 'duplicate' ELSE action END AS action
  FROM joined LEFT JOIN stay ON new_hash = h)"""


def scan_diff(spark, sf_dir):
    known, seen = _snapshots(spark, sf_dir)
    return C.scan_diff(known, seen)


def scan_report(spark, sf_dir):
    known, seen = _snapshots(spark, sf_dir)
    return C.scan_diff(known, seen).groupBy("action").agg(F.count("*").alias("n"))


def upsert_documents(spark, sf_dir):
    known, seen = _snapshots(spark, sf_dir)
    return C.upsert(known.select("collection", "path", "hash"), seen.select("collection", "path", "hash"), ["collection", "path"])


def soft_delete(spark, sf_dir):
    known, seen = _snapshots(spark, sf_dir)
    current = known.select("collection", "path", F.lit(1).alias("active"))
    return C.soft_delete(current, seen, ["collection", "path"])


def _chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "hash")
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("day"))
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(labelled, "doc_id", "left_semi").join(seen, "doc_id", "left").select(
        "hash", F.lit(0).alias("seq"), F.when(F.col("doc_id") % 2 == 0, F.col("day")).alias("chunk_date"))


_CHUNKS = f"""WITH {DOCS},
chunks AS (
  SELECT hash, CASE WHEN doc_id % 2 = 0 THEN ts::DATE END AS chunk_date
  FROM docs LEFT JOIN events ON event_id = doc_id WHERE doc_id IN (SELECT doc_id FROM labels))"""


def pending_chunks(spark, sf_dir):
    return C.pending(documents(spark, sf_dir).withColumn("active", F.lit(1)), _chunks(spark, sf_dir))


def latest_chunk_date(spark, sf_dir):
    suffixes = documents(spark, sf_dir).where(F.col("lang") == "en").select(F.concat(F.lit("/"), F.substring_index("path", "/", -1)).alias("suffix"))
    return C.latest_dates(_chunks(spark, sf_dir), documents(spark, sf_dir), suffixes)


def temporal_window_paths(spark, sf_dir):
    return C.in_window(_chunks(spark, sf_dir), documents(spark, sf_dir), "2024-01-02", "2024-01-03")


def exact_duplicates(spark, sf_dir):
    return C.exact_duplicates(documents(spark, sf_dir))


def canonical_documents(spark, sf_dir):
    return C.canonical(documents(spark, sf_dir))


def near_duplicates_blocked(spark, sf_dir):
    """Documents whose whole texts are alike, in blocks of one title: the slug of the first six words."""
    return C.near_duplicates(documents(spark, sf_dir).select("doc_id", X.slugify(X.first_words(F.col("text"), 6)).alias("stem"), "text"), "stem")


def catalogue(spark, sf_dir):
    """Documents and characters by collection and language, by collection, and in all."""
    docs = documents(spark, sf_dir)
    return docs.rollup("collection", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def size_classes(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("collection", C.size_class(F.col("text")).alias("size_class")).agg(F.count("*").alias("n"))


def corpus_profile(spark, sf_dir):
    """Conditional counts over collections."""
    docs = documents(spark, sf_dir)
    return docs.groupBy("collection").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"\d{4}-\d{2}-\d{2}")).alias("dated"),
        F.count_if(F.col("path").rlike(r"/(?:en|de)/")).alias("english_or_german"), F.countDistinct("hash").alias("contents"))


def text_keys(spark, sf_dir):
    """Slugs, names and titles of whole texts."""
    docs = documents(spark, sf_dir).withColumn("head", F.col("text"))
    return docs.select("doc_id", X.slugify("head").alias("slug"), X.heading_slug("head", 20).alias("short_slug"), X.kebab_case("head").alias("kebab"), X.title_key("head").alias("title_key"))


def chunks(spark, sf_dir):
    made = documents(spark, sf_dir).select("doc_id", F.inline(X.chunk_text(F.col("text"), 2000)))
    return made.select("doc_id", F.col("seq").cast("long"), F.col("pos").cast("long"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("chunk_hash"))


def _notes(spark, sf_dir):
    """Turns of conversations as notes: a block of fields, a heading, the text; read back as title, date and snippet. What is null of them is empty."""
    turns = table(spark, sf_dir, "conversations")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.to_date("o_orderdate").alias("day"))
    rows = turns.join(orders, "conv_id", "left")
    note = F.concat(
        F.lit("---\nowner: "), F.coalesce("role", F.lit("")), F.lit("\ntitle: Note "), F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
        F.coalesce(F.concat(F.lit("\ndate: "), F.col("day").cast("string")), F.lit("")), F.lit("\n---\n# Heading\n\n"), F.coalesce("text", F.lit("")))
    return rows.withColumn("note", note).withColumn("file", F.concat(F.lit("notes/2024-02-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(".md")))


def extracted_dates(spark, sf_dir):
    """Titles, dates and snippets of notes. Only the fields date a note, not its text; without a number it has no title or date, without a text no snippet."""
    rows, known = _notes(spark, sf_dir), F.col("conv_id").isNotNull()
    day = C.document_date(X.frontmatter(F.col("note")), F.col("file"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-06-30").cast("date"))
    title = X.extract_title(F.col("note"), F.lit("some-note"))
    snippet = F.when(F.col("text").isNotNull(), X.snippet(F.col("note")))
    return rows.select("conv_id", "turn", F.when(known, title).alias("title"), F.when(known, day).alias("day"), F.sha2(snippet, 256).alias("snippet_hash"))


_NOTES = r"""WITH notes AS (
  SELECT conv_id, turn, role, text, o_orderdate::DATE AS day, 'notes/2024-02-0' || (conv_id % 9 + 1) || '.md' AS file,
         '---' || chr(10) || 'owner: ' || role || chr(10) || 'title: Note ' || conv_id || coalesce(chr(10) || 'date: ' || o_orderdate::DATE::VARCHAR, '')
           || chr(10) || '---' || chr(10) || '# Heading' || chr(10) || chr(10) || text AS note
  FROM conversations LEFT JOIN orders ON o_orderkey = conv_id)"""


def date_formats(spark, sf_dir):
    """How dates are written, by role; numbers below zero too have one of the forms."""
    rows, form, day = _notes(spark, sf_dir), F.col("conv_id") % 4, F.col("day").cast("string")
    value = F.when(form == 0, day).when(form == 1, F.date_format("day", "dd/MM/yyyy")).when(form == 3, "").otherwise(F.concat(day, F.lit("T10:00")))
    classes = rows.withColumn("class", C.date_class(value)).groupBy("role")
    return classes.agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("absent", "datetime", "iso", "non_iso")])


def html_clean(spark, sf_dir):
    """Titles and cleaned markup of pages: anchors as links, comments and inline tags out."""
    cleaned = X.clean_markdown(F.col("html"))
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(cleaned).cast("long").alias("n"), F.sha2(cleaned, 256).alias("clean_hash"))


def intents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", C.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def query_intents(spark, sf_dir):
    """Queries made from rows of the star tables, one form for each class."""
    forms = F.array(*[F.concat(F.lit(a), F.col("p_name"), F.lit(b)) for a, b in (("when did ", " change"), ("compare ", " with another"), ("who is ", "?"), ("how to install ", ""), ("", "_id"), ("thoughts on ", " and such matters"))])
    asked = table(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")).alias("q"))
    return asked.select("p_partkey", C.intent(F.col("q")).alias("intent"))


def note_classes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    note = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## 10:15 stand-up\n"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("We decided: "), "text")).otherwise(F.col("text"))
    kinds = turns.withColumn("c", C.note_class(note)).groupBy("c.kind", "c.confidence").agg(F.count("*").alias("n"))
    return kinds.withColumn("confirm", F.col("confidence") < 0.7)


_RULE = lambda rules, column, default: "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


def claims_topn(spark, sf_dir):
    """The three claims of each answer with the largest score."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    found = turns.select("conv_id", "turn", F.inline(X.claims(F.col("text"))))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("score").desc(), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3).select("conv_id", "turn", "rank", "pos", F.round("score", 6).alias("score"))


def contamination(spark, sf_dir):
    """(item_id, doc_id, part): the part of a benchmark passage's 8-word runs that a document holds, from a half on.

    Runs of the passages are few; documents' runs are joined with them while they are scanned.
    """
    def runs(rows, key):
        """Each row's runs, its words being split once: places are exploded, then each run is joined from its words."""
        words = spread(rows.select(key, "text")).select(key, X.split_words(F.lower("text")).alias("_words"))
        starts = words.select(key, F.explode(F.transform(F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(F.lit(1), F.size("_words") - 7)).alias(f"w{k}") for k in range(8)]), run)).alias("run"))
        return starts

    def run(zipped):
        return F.array_join(F.array(*[zipped[f"w{k}"] for k in range(8)]), " ")

    asked = runs(queries(spark, sf_dir).withColumnRenamed("query_id", "item_id"), "item_id").distinct()
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    asked = asked.join(small(sizes), "item_id")
    held = runs(documents(spark, sf_dir), "doc_id").join(small(asked.select("run").distinct()), "run", "left_semi").distinct()
    met = held.join(small(asked), "run").groupBy("item_id", "doc_id").agg(F.count("*").alias("met"), F.max("n").alias("n"))
    return met.select("item_id", "doc_id", F.round(F.col("met") / F.col("n"), 6).alias("part")).where(F.col("part") >= 0.5)


def fill_forward_section(spark, sf_dir):
    """The last purchase's value carried on over each user's events."""
    events = table(spark, sf_dir, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return C.fill_forward(events, "last_purchase", "event_id", "user_id").select("event_id", "user_id", "last_purchase")


def marker_sections(spark, sf_dir):
    events = C.sections(table(spark, sf_dir, "events"), F.col("event_type") == "error", "event_id", "user_id")
    return events.groupBy("user_id", "section").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def keep_last_n(spark, sf_dir):
    return C.keep_last(table(spark, sf_dir, "events"), 90, "ts", "event_type", "event_id").select("event_id", "event_type")


def json_fields(spark, sf_dir):
    """Scores read from JSON in text, held between 0 and 1."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    text = F.concat(F.lit("The answer: {\"score\": "), (k / 80).cast("string"), F.lit("} as asked"))
    return events.select("event_id", F.round(X.json_score(text), 6).alias("score"))


_HEAD = "array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:6], ' ')"
_SLUG = "trim(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '-')"
_CLEAN = "html"
for _p, _to in [
    (r"\r\n?", r"\n"), (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", ""), (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"(?is)<a\s[^>]*?href=[\"''']([^\"''']*)[\"'''][^>]*>(.*?)</a>".replace("'''", "''"), r"[\2](\1)"), (r"(?s)<!--.*?-->", ""), (r"(?i)<img\b[^>]*>", ""),
    (r"(?i)</?(?:b|i|em|strong|span|div|p|br|sup|sub|center|u|font|small|details|summary)\b[^>]*>", ""), (r"\n{4,}", "\n\n\n"),
]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {'chr(10)' if _to == chr(92) + 'n' else repr(_to) if chr(10) not in _to else 'chr(10) || chr(10) || chr(10)'}, 'g')".replace("'\\\\", "'\\").replace("\\\\", "\\")
_RUNS8 = "list_distinct(list_transform(range(1, greatest(len(words) - 7, 1) + 1), lambda i: array_to_string(words[i:i + 7], ' ')))"
_LOW = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"

def notes_with_fields(spark, sf_dir):
    """Documents under a block of fields, a third of which had another one."""
    docs = documents(spark, sf_dir)
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: old\n---\n"), "text")).otherwise(F.col("text"))
    new = X.with_frontmatter(given, {"title": F.concat(F.lit('The "'), "path", F.lit('"')), "source": F.col("source"), "domain": F.col("lang")})
    return docs.select("doc_id", F.sha2(new, 256).alias("note_hash"))


def order_store(spark, sf_dir):
    """Orders upserted into a store: all, then a batch of other prices and deletions, and that batch again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = Store(spark, new_path(spark, "orders"), "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderkey"], 16)
    k = F.col("o_orderkey")
    changed = o.where((k % 10 == 0) | (k % 17 == 0)).select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), (k % 17 == 0).alias("_deleted"))
    return store, [store.apply(o, 0), store.apply(changed, 1), store.apply(changed, 2)]


def store_upserts(spark, sf_dir):
    """What the store holds after its batches."""
    return order_store(spark, sf_dir)[0].rows()


QUERIES = {
    "store_upserts": store_upserts, "notes_with_fields": notes_with_fields,
    "scan_diff": scan_diff, "scan_report": scan_report, "upsert_documents": upsert_documents, "soft_delete": soft_delete,
    "pending_chunks": pending_chunks, "latest_chunk_date": latest_chunk_date, "temporal_window_paths": temporal_window_paths,
    "exact_duplicates": exact_duplicates, "canonical_documents": canonical_documents, "near_duplicates_blocked": near_duplicates_blocked,
    "catalogue_rollup": catalogue, "size_classes": size_classes, "corpus_profile": corpus_profile, "text_keys": text_keys, "chunk_text": chunks,
    "extracted_dates": extracted_dates, "date_formats": date_formats, "html_clean": html_clean, "intent_counts": intents, "query_intents": query_intents,
    "note_classes": note_classes, "claims_topn": claims_topn, "benchmark_contamination": contamination, "fill_forward_section": fill_forward_section,
    "marker_sections": marker_sections, "keep_last_n": keep_last_n, "json_score_extract": json_fields,
}
ORACLE_SQL = {
    "notes_with_fields": f"""WITH {DOCS} SELECT doc_id, sha256('---' || chr(10) || 'title: "The \\"' || path || '\\""' || chr(10) || 'source: ' || source || chr(10) || 'domain: ' || lang || chr(10) || '---' || chr(10) || chr(10)
  || ltrim(text, ' ' || chr(9) || chr(10) || chr(13))) AS note_hash FROM docs""",
    "store_upserts": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 0""",
    "scan_diff": f"{_SNAP} SELECT * FROM diff",
    "scan_report": f"{_SNAP} SELECT action, count(*) AS n FROM diff GROUP BY action",
    "upsert_documents": f"{_SNAP} SELECT * FROM seen UNION ALL SELECT * FROM known ANTI JOIN seen USING (collection, path)",
    "soft_delete": f"{_SNAP} SELECT k.collection, k.path, CASE WHEN s.path IS NULL THEN 0 ELSE 1 END AS active FROM known k LEFT JOIN seen s USING (collection, path)",
    "pending_chunks": f"{_CHUNKS} SELECT hash, min(path) AS path FROM docs ANTI JOIN chunks USING (hash) WHERE length(text) > 0 GROUP BY hash",
    "latest_chunk_date": f"""{_CHUNKS} SELECT d.path, max(chunk_date) AS chunk_date FROM chunks JOIN docs d USING (hash)
WHERE chunk_date IS NOT NULL AND EXISTS (SELECT 1 FROM documents x WHERE x.lang = 'en' AND ends_with(d.path, '/' || x.doc_id || '.md')) GROUP BY d.path""",
    "temporal_window_paths": f"{_CHUNKS} SELECT DISTINCT path FROM chunks JOIN docs USING (hash) WHERE chunk_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'",
    "exact_duplicates": f"WITH {DOCS} SELECT hash, count(*) AS n, min(path) AS first_path FROM docs GROUP BY hash HAVING count(*) > 1",
    "canonical_documents": f"WITH {DOCS} SELECT hash, arg_min(doc_id, path) AS doc_id, min(path) AS path, count(*) AS n FROM docs GROUP BY hash",
    "near_duplicates_blocked": f"""WITH heads AS (SELECT doc_id, text, {_HEAD} AS head FROM documents),
one AS (SELECT {_SLUG} AS role, lower(text) AS t, min(doc_id) AS id FROM heads GROUP BY 1, 2),
runs AS (SELECT DISTINCT role, id, CASE WHEN length(t) < 3 THEN t ELSE t[i:i + 2] END AS run FROM (SELECT *, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM one)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM runs a JOIN runs b ON a.role = b.role AND a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS likeness FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE round(c / (x.n + y.n - c), 6) >= 0.9""",
    "catalogue_rollup": """SELECT source AS collection, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(source, lang) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (source, lang)""",
    "size_classes": """SELECT source AS collection, CASE WHEN strlen(trim(text)) < 500 THEN 'small' WHEN strlen(trim(text)) > 50000 THEN 'split' ELSE 'keep' END AS size_class, count(*) AS n
FROM documents GROUP BY 1, 2""",
    "corpus_profile": f"""WITH {DOCS} SELECT collection, count(*) AS n, count(*) FILTER (regexp_matches(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS dated,
count(*) FILTER (lang IN ('en', 'de')) AS english_or_german, count(DISTINCT hash) AS contents FROM docs GROUP BY collection""",
    "text_keys": f"""WITH heads AS (SELECT doc_id, text AS head FROM documents)
SELECT doc_id, {_SLUG} AS slug, regexp_replace({_SLUG}[1:20], '-+$', '') AS short_slug,
  trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(head, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_.]+', '-', 'g')), '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g'), '-') AS kebab,
  trim(regexp_replace(regexp_replace(lower(head), '\\.md$', ''), '[-_\\s]+', '-', 'g'), '-') AS title_key FROM heads""",
    "chunk_text": """WITH made AS (SELECT doc_id, i * 2000 AS pos, text[i * 2000 + 1:i * 2000 + 2000] AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 1) // 2000) + 1)) AS i FROM documents))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, pos, length(t) AS n, sha256(t) AS chunk_hash FROM made WHERE trim(t) <> ''""",
    "extracted_dates": f"""{_NOTES}
SELECT conv_id, turn, 'Note ' || conv_id AS title, CASE WHEN day BETWEEN DATE '2000-01-01' AND DATE '2024-07-01' THEN day ELSE file[12:21]::DATE END AS day,
  sha256(trim('# Heading' || chr(10) || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13))[1:300]) AS snippet_hash FROM notes""".replace("file[12:21]", "regexp_extract(file, '\\d{4}-\\d{2}-\\d{2}')"),
    "date_formats": f"""{_NOTES}, classes AS (SELECT role, CASE WHEN conv_id % 4 = 3 OR day IS NULL THEN 'absent' WHEN conv_id % 4 = 0 THEN 'iso' WHEN conv_id % 4 = 1 THEN 'non_iso' ELSE 'datetime' END AS c FROM notes)
SELECT role, count(*) FILTER (c = 'absent') AS absent, count(*) FILTER (c = 'datetime') AS datetime, count(*) FILTER (c = 'iso') AS iso, count(*) FILTER (c = 'non_iso') AS non_iso FROM classes GROUP BY role""",
    "html_clean": f"""WITH cleaned AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim({_CLEAN}, ' ' || chr(9) || chr(10)) || chr(10) AS t FROM pages)
SELECT page_id, title, length(t) AS n, sha256(t) AS clean_hash FROM cleaned""",
    "intent_counts": f"SELECT role, {_RULE(C.INTENT_RULES, 'text', 'semantic')} AS intent, count(*) AS n FROM conversations GROUP BY 1, 2",
    "query_intents": f"""WITH asked AS (SELECT p_partkey, ([ 'when did ' || p_name || ' change', 'compare ' || p_name || ' with another', 'who is ' || p_name || '?', 'how to install ' || p_name,
  p_name || '_id', 'thoughts on ' || p_name || ' and such matters'])[p_partkey % 6 + 1] AS q FROM part) SELECT p_partkey, {_RULE(C.INTENT_RULES, 'q', 'semantic')} AS intent FROM asked""",
    "note_classes": f"""WITH notes AS (SELECT CASE WHEN turn % 3 = 0 THEN '## 10:15 stand-up' || chr(10) || text WHEN turn % 3 = 1 THEN 'We decided: ' || text ELSE text END AS note FROM conversations),
kinds AS (SELECT {_RULE(C.NOTE_RULES, 'note', 'unknown')} AS kind FROM notes)
SELECT kind, CASE WHEN kind = 'unknown' THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence, count(*) AS n, kind = 'unknown' AS confirm FROM kinds GROUP BY kind""",
    "benchmark_contamination": f"""WITH asked AS (SELECT item_id, {_RUNS8} AS runs FROM (SELECT item_id, {_LOW} AS words FROM benchmark)),
held AS (SELECT doc_id, unnest({_RUNS8}) AS run FROM (SELECT doc_id, {_LOW} AS words FROM documents)),
met AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS part FROM (SELECT item_id, len(runs) AS n, unnest(runs) AS run FROM asked) JOIN held USING (run) GROUP BY 1, 2)
SELECT * FROM met WHERE part >= 0.5""",
    "fill_forward_section": """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""",
    "marker_sections": """WITH s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS section FROM events)
SELECT user_id, section, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""",
    "keep_last_n": """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 90""",
    "json_score_extract": """SELECT event_id, round(greatest(0.0, least(1.0, CAST(json_extract(props, '$.k') AS DOUBLE) / 80)), 6) AS score FROM events""",
}
