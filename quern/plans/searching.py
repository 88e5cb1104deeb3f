"""Queries over scopes, budgets, hits, context, embedding runs and answers, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quern.functions.stemming import stems
from quern.functions.text import first_words, token_estimate, tokens
from quern.operators import corpus as C
from quern.operators import hybrid as H
from quern.operators import ranking as R
from quern.operators import search as S
from quern.operators import suggesting as N
from quern.plans.paths import _FILES, files
from quern.plans.tables import DOCS, document_index, documents, queries, table

AGENTS = [("a0", ["c0", "x"]), ("a1", ["c1"]), ("a2", ["c2", "x"])]


def scope_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    scope = F.element_at(F.array(*[F.lit(x) for x in S.SCOPES]), (k % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(k, scope.alias("scope"), F.when(k % 7 != 0, F.concat(F.lit("a"), (k % 4).cast("string"))).alias("agent"))
    found = S.resolve_scopes(asked, spark.createDataFrame(AGENTS, "agent string, collections array<string>"), ["docs", "x"])
    return found.select("c_custkey", F.array_join("collections", ",").alias("collections"))


def intent_budgets(spark, sf_dir):
    from quern.plans.curation import query_intents

    return query_intents(spark, sf_dir).groupBy("intent", S.budget_of(F.col("intent")).alias("budget")).agg(F.count("*").alias("n"))


def cache_keys(spark, sf_dir):
    """Requests of orders by their key: a word in two cases, with more or fewer spaces, collections in any order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("  What IS "), "o_orderpriority")).otherwise(F.concat(F.lit("what  is\t"), F.lower("o_orderpriority"), F.lit(" ")))
    listed = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return o.groupBy(S.cache_key(text, F.col("o_orderstatus"), F.lit(None).cast("string"), listed).alias("key")).agg(F.count("*").alias("n"))


def document_by_path(spark, sf_dir):
    """Contents of asked paths; null for one without."""
    asked = files(spark, sf_dir).select("path").unionByName(documents(spark, sf_dir).where(F.col("doc_id") % 9 == 0).select("path")).distinct()
    held = documents(spark, sf_dir).select("path", "hash")
    return asked.join(held, "path", "left")


def _chunks(spark, sf_dir):
    from quern.plans.curation import _chunks as made

    return made(spark, sf_dir)


def staged_chunks(spark, sf_dir):
    """Chunks whose content is there."""
    held = documents(spark, sf_dir).where(F.length("text") > 0).select("hash", F.length("text").cast("long").alias("size")).distinct()
    return _chunks(spark, sf_dir).join(held, "hash").select("hash", "seq", "chunk_date", "size")


def hits_resolved(spark, sf_dir):
    """Hits of 50 queries with their documents' paths: active ones of two collections, ranks as they were."""
    docs = documents(spark, sf_dir).withColumn("active", (F.col("doc_id") % 3 != 0).cast("int"))
    hits = documents(spark, sf_dir).select((F.col("doc_id") % 50).alias("query_id"), F.floor(F.col("doc_id") / 50).alias("rank"), "hash")
    return S.resolve_hits(hits, docs.select("hash", "path", "collection", "active"), ["src0", "src1"]).select("query_id", "rank", "path")


def merged_paths(spark, sf_dir):
    f = files(spark, sf_dir)
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("vault/"), "path")).otherwise(F.col("path"))
    ranked = f.groupBy(F.col("source").alias("query_id"), path.alias("path")).agg(F.min("id").alias("rank"))
    return S.merged_paths(ranked, "vault")


def prep_context(spark, sf_dir):
    """Turns of a conversation as what was found."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("title"), "text")
    return S.context(t).select("query_id", F.sha2("context", 256).alias("context_hash"))


def briefing_trim(spark, sf_dir):
    """Turns as sources of a briefing, the earlier the more important, within 120 tokens."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("priority"), token_estimate(F.col("text")).cast("long").alias("tokens"))
    return S.trimmed(t, 120, "conv_id")


def _flaky(texts: list[str]) -> list[list[float]]:
    """An offline provider that refuses some texts."""
    if any(len(x) % 17 == 0 for x in texts):
        raise ValueError("bad request")
    return [S.offline_vector(x, 4) for x in texts]


def embed_run(spark, sf_dir):
    """Turns of conversations embedded; refused ones fail alone."""
    done = S.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _flaky, 4)
    return done.select("conv_id", "turn", "failed", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", 4), 6).alias("last"))


def embed_report(spark, sf_dir):
    return S.embed_report(S.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), partial(_flaky), 4))


def guide_topics(spark, sf_dir):
    """Conversations as guides of a section a turn, asked for a topic."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit(" part\n"), "text").alias("t")).alias("s"))
    guides = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select("conv_id", F.concat(F.lit("# Guide\nintro\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n")).alias("text"))
    topic = F.element_at(F.array(F.lit("USER"), F.lit("intro"), F.lit("nowhere at all")), (F.col("conv_id") % 3 + 1).cast("int"))
    return guides.select("conv_id", F.sha2(S.topic_sections(F.col("text"), topic), 256).alias("section_hash"))


def stated_confidence(spark, sf_dir):
    """Answers that state a confidence in four ways, or none."""
    v = F.floor(F.col("value")).cast("int")
    forms = F.array(
        F.concat(F.lit('{"confidence": '), v.cast("string"), F.lit("e-2}")), F.concat(F.lit("My confidence is "), v.cast("string"), F.lit("%.")), F.concat(F.lit("Confidence = -"), v.cast("string")), F.lit("I can't say"))
    answer = F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(S.confidence(answer), 6).alias("confidence"))


def heading_parts(spark, sf_dir):
    """Long documents as notes of a heading a line, cut at their headings."""
    text = F.regexp_replace("text", r"\n", "\n## ")
    return documents(spark, sf_dir).select("doc_id", F.inline(S.split_at_headings(text, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), 2000))).select("doc_id", "stem", F.length("text").cast("long").alias("n"))


def run_deltas(spark, sf_dir):
    from quern.plans.evals import _means

    return S.deltas(_means(spark, sf_dir, True), _means(spark, sf_dir, False))


def corpus_settings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("lang") == "de").alias("dated"), F.count_if(F.col("doc_id") % 20 == 0).alias("procedural"), F.count_if(F.col("doc_id") % 31 == 0).alias("entities"), F.count_if(F.col("lang") == "fr").alias("pdf"))
    return S.recommended(d)


def vocabulary_stems(spark, sf_dir):
    """Stems of all words of the documents."""
    return stems(documents(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term")))


def bm25_stemmed(spark, sf_dir):
    return R.bm25(documents(spark, sf_dir).select("doc_id", "text"), queries(spark, sf_dir), stemmed=True)


def table_states(spark, sf_dir):
    """Whether tables of an index are there and hold rows."""
    docs = documents(spark, sf_dir)
    rows = [("documents", S.table_state(docs)), ("none", S.table_state(docs.where("doc_id < 0"))), ("missing", S.table_state(None)),
            ("needs rebuild", str(S.needs_rebuild(docs.where("doc_id % 2 = 0"), docs)).lower()), ("whole", str(S.needs_rebuild(docs, docs)).lower())]
    return spark.createDataFrame(rows, "name string, state string")


def summary_counts(spark, sf_dir):
    """Summaries of two levels, stored again for some paths, counted."""
    f = files(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))
    stored = f.select("path", F.lit("L0").alias("level"), F.lit("old").alias("summary"))
    new = f.where(F.col("n") % 2 == 0).select("path", F.explode(F.array(F.lit("L0"), F.lit("L1"))).alias("level"), F.lit("new").alias("summary"))
    return C.upsert(stored, new, ["path", "level"]).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("summary") == "new").alias("fresh"))


def scanned_paths(spark, sf_dir):
    """The first 250 active paths, as a scan for entities reads them."""
    return files(spark, sf_dir).where(F.col("id") % 4 != 0).select("path", "id").orderBy("path", "id").limit(250)


def label_grades(spark, sf_dir):
    """Second words of parts' names as names, and the names of the same type's other parts as candidates."""
    p = table(spark, sf_dir, "part")
    name = F.split_part("p_name", F.lit(" "), F.lit(2))
    names, labels = p.select("p_type", name.alias("name")).distinct(), p.select("p_type", F.upper("p_name").alias("label")).distinct()
    return names.join(labels, "p_type").groupBy(N.match_grade(F.col("name"), F.col("label")).alias("grade")).agg(F.count("*").alias("n"))


def _beginning(path, text, bound):
    """An offline provider: a text's first words; texts of a number of characters that seven divides are refused."""
    if len(text) % 7 == 0:
        raise ValueError("refused")
    return " ".join(text.split(" ")[: bound // 15])


def summary_run(spark, sf_dir):
    """Summaries of all documents by the offline provider, in two lengths."""
    done = N.summaries(documents(spark, sf_dir).select("path", "text"), _beginning)
    return done.select("path", "level", F.sha2("summary", 256).alias("summary_hash"), F.when(~F.col("failed"), F.col("tokens")).alias("tokens"), "failed")


def _as_vectors(texts):
    """64 components that only the text decides; one in seven texts is refused, by its length."""
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("refused")
    return [S.offline_vector(t, 32) + S.offline_vector(t[::-1], 32) for t in texts]


def hybrid_topk(spark, sf_dir):
    """Passages' first six words asked for in one call: a fifth in one collection only, vectors by the offline provider."""
    docs, index = documents(spark, sf_dir), document_index(spark, sf_dir)
    day = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("chunk_date"))
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count("*").alias("degree"))
    held = docs.select("doc_id", "path", "collection").join(day, "doc_id", "left").join(degree, "doc_id", "left").join(index.docs, "doc_id")
    one = F.when(F.col("query_id") % 5 == 0, F.array(F.lit("src1")))
    asked = queries(spark, sf_dir).select("query_id", first_words(F.col("text"), 6).alias("text"), F.lit("2024-04-10").cast("date").alias("as_of"), one.alias("collections"))
    vectors = table(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id"), "collection"), "vec_id")
    return H.hybrid_search(asked, held, index.search, H.exact_near(vectors), _as_vectors, 64)


def claims_contradicted(spark, sf_dir):
    """Answers' claims against documents, scored by the part of a claim's words that a document's beginning has."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    notes = turns.select(F.concat_ws("-", "conv_id", "turn").alias("doc"), "text")
    shared = lambda claim, text: {"direct": F.round(F.size(F.array_intersect(F.array_distinct(tokens(claim)), tokens(text))) / F.greatest(F.size(F.array_distinct(tokens(claim))), F.lit(1)), 6)}
    docs = documents(spark, sf_dir).select("doc_id", "path", "text")
    return H.contradicted(notes, docs, document_index(spark, sf_dir).search, shared, least=0.3).select("doc", "claim", "path", "score", "category", "rank")


QUERIES = {
    "label_grades": label_grades, "summary_run": summary_run,
    "hybrid_topk": hybrid_topk, "claims_contradicted": claims_contradicted,
    "scope_resolution": scope_resolution, "intent_budgets": intent_budgets, "cache_keys": cache_keys, "document_by_path": document_by_path, "staged_chunks": staged_chunks,
    "hits_resolved": hits_resolved, "merged_paths": merged_paths, "prep_context": prep_context, "briefing_trim": briefing_trim, "embed_run": embed_run, "embed_report": embed_report,
    "guide_topics": guide_topics, "stated_confidence": stated_confidence, "heading_parts": heading_parts, "run_deltas": run_deltas, "corpus_settings": corpus_settings,
    "vocabulary_stems": vocabulary_stems, "bm25_stemmed": bm25_stemmed, "table_states": table_states, "summary_counts": summary_counts, "scanned_paths": scanned_paths,
}


def _sql() -> dict[str, str]:
    from quern.plans.curation import _CHUNKS
    from quern.plans.curation import ORACLE_SQL as CURATION
    from quern.plans.evals import _MEANS

    byte = lambda k: f"(('0x' || substr(h, {2 * k + 1}, 2))::INT - 127.5::DOUBLE)"
    norm = "sqrt(" + " + ".join(f"{byte(k)} * {byte(k)}" for k in range(4)) + ")"
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    return {
        "scope_resolution": """WITH asked AS (SELECT c_custkey, (['shared', 'agent', 'shared+agent', 'all-agents', 'everything'])[c_custkey % 5 + 1] AS scope, CASE WHEN c_custkey % 7 <> 0 THEN 'a' || (c_custkey % 4) END AS agent FROM customer),
own AS (SELECT *, CASE agent WHEN 'a0' THEN 'c0,x' WHEN 'a1' THEN 'c1' WHEN 'a2' THEN 'c2,x' WHEN 'a3' THEN 'a3-memory' END AS o FROM asked)
SELECT c_custkey, CASE scope WHEN 'shared' THEN 'docs,x' WHEN 'agent' THEN o WHEN 'shared+agent' THEN CASE WHEN o IS NULL THEN 'docs,x' ELSE 'docs,x,' || replace(o, ',x', '') END WHEN 'all-agents' THEN 'c0,x,c1,c2' ELSE 'docs,x,c0,c1,c2' END AS collections FROM own""",
        "intent_budgets": f"SELECT intent, CASE WHEN intent IN ('keyword', 'entity') THEN 1500 WHEN intent = 'multi_hop' THEN 5000 ELSE 3000 END AS budget, count(*) AS n FROM ({CURATION['query_intents']}) GROUP BY 1, 2",
        "cache_keys": "SELECT sha256('what is ' || lower(o_orderpriority) || chr(0) || o_orderstatus || chr(0) || chr(0) || 'a,b') AS key, count(*) AS n FROM orders GROUP BY 1",
        "document_by_path": f"WITH {_FILES}, {DOCS}, asked AS (SELECT path FROM files UNION SELECT path FROM docs WHERE doc_id % 9 = 0) SELECT asked.path, hash FROM asked LEFT JOIN docs ON docs.path = asked.path",
        "staged_chunks": f"{_CHUNKS} SELECT hash, 0 AS seq, chunk_date, size FROM chunks JOIN (SELECT DISTINCT hash, length(text) AS size FROM docs WHERE length(text) > 0) USING (hash)",
        "hits_resolved": f"WITH {DOCS}, hits AS (SELECT doc_id % 50 AS query_id, doc_id // 50 AS rank, hash FROM docs) SELECT query_id, rank, path FROM hits JOIN docs USING (hash) WHERE doc_id % 3 <> 0 AND collection IN ('src0', 'src1')",
        "merged_paths": f"WITH {_FILES}, once AS (SELECT source AS query_id, path, min(id) AS r FROM files GROUP BY 1, 2) SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY r, path) AS rank FROM once",
        "prep_context": "SELECT conv_id AS query_id, sha256(string_agg('[' || role || ']' || chr(10) || text[1:500], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS context_hash FROM conversations WHERE turn < 5 GROUP BY conv_id",
        "briefing_trim": f"""WITH t AS (SELECT conv_id, turn AS priority, CASE WHEN len({words}) = 0 THEN 0 ELSE greatest(1, floor(len({words}) * 1.3::DOUBLE)::BIGINT) END AS tokens FROM conversations),
k AS (SELECT *, CAST(greatest(0, least(tokens, 120 - (sum(tokens) OVER (PARTITION BY conv_id ORDER BY priority) - tokens))) AS BIGINT) AS kept FROM t) SELECT * FROM k WHERE kept > 0""",
        "embed_run": f"""WITH t AS (SELECT conv_id, turn, length(text) % 17 = 0 AS failed, sha256(text) AS h FROM conversations)
SELECT conv_id, turn, failed, CASE WHEN NOT failed THEN round({byte(0)} / {norm}, 6) END AS first, CASE WHEN NOT failed THEN round({byte(3)} / {norm}, 6) END AS last FROM t""",
        "embed_report": "SELECT count(*) FILTER (length(text) % 17 <> 0) AS embedded, count(*) FILTER (length(text) % 17 = 0) AS failed FROM conversations",
        "stated_confidence": """WITH v AS (SELECT event_id, CAST(floor(value) AS INT) AS v FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(greatest(0, least(1, v / 100)), 6) WHEN 1 THEN round(greatest(0, least(1, v / 100)), 6) WHEN 2 THEN 0.0::DOUBLE END AS confidence FROM v""",
        "run_deltas": f"WITH {_MEANS} SELECT category, round(coalesce(l.mean, 0) - coalesce(e.mean, 0), 4) AS delta FROM early e FULL JOIN late l USING (category)",
        "corpus_settings": """SELECT source, count(*) FILTER (lang = 'de') / count(*) > 0.15 AS temporal_boost, count(*) FILTER (doc_id % 20 = 0) / count(*) > 0.05 AS procedural_boost, count(*) FILTER (doc_id % 31 = 0) / count(*) > 0.03 AS entity_boost,
CASE WHEN count(*) FILTER (lang = 'fr') / count(*) > 0.20 THEN 'rrf' ELSE 'bm25_primary' END AS fusion_strategy FROM documents GROUP BY source""",
        "table_states": "SELECT 'documents' AS name, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS state FROM documents UNION ALL SELECT 'none', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM documents WHERE doc_id < 0 UNION ALL SELECT 'missing', 'missing' UNION ALL SELECT 'needs rebuild', CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END FROM documents WHERE doc_id % 2 <> 0 UNION ALL SELECT 'whole', 'false'",
        "summary_counts": f"WITH {_FILES}, f AS (SELECT path, count(*) AS n FROM files GROUP BY path) SELECT 'L0' AS level, count(*) AS n, count(*) FILTER (n % 2 = 0) AS fresh FROM f UNION ALL SELECT 'L1', count(*) FILTER (n % 2 = 0), count(*) FILTER (n % 2 = 0) FROM f",
        "scanned_paths": f"WITH {_FILES} SELECT path, id FROM files WHERE id % 4 <> 0 ORDER BY path, id LIMIT 250",
    }


ORACLE_SQL = _sql()
