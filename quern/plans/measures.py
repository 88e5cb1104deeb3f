"""Queries over retrieval metrics, gates, latencies, samples and event windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import first_words
from quern.operators import corpus as C
from quern.operators import evaluation as E
from quern.operators import ranking as R
from quern.operators.timeline import timeline, write_chunks
from quern.plans.retrieval import KEYWORD, _Q, _WORDS, _tokens, bm25_sql
from quern.plans.tables import document_index, documents, queries, table
from quern.shared import cut, new_path
from quern.streaming.events import sessions, tumbling

WEIGHTS = {"recall": 0.25, "temporal": 0.2, "entity": 0.2, "conceptual": 0.15, "multi_hop": 0.1, "procedural": 0.1}


def _legs(spark, sf_dir):
    """Two ranked legs, written, as a query and its gold read both."""
    docs, asked = documents(spark, sf_dir).select("doc_id", "text"), queries(spark, sf_dir)
    return cut(document_index(spark, sf_dir).search(asked, k=20)), cut(R.keyword_overlap(docs, asked))


def _gold(spark, sf_dir, found):
    """Of what either leg finds, documents labelled of quality are relevant, clean ones twice."""
    ids = found[0].select("query_id", "doc_id").unionByName(found[1].select("query_id", "doc_id")).distinct()
    labels = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return ids.join(labels, "doc_id").select("query_id", "doc_id", (2 - F.coalesce("toxic", F.lit(0))).alias("rel"))


_GOLD = f"""{bm25_sql(_Q, k=20)}, {KEYWORD},
gold AS (SELECT query_id, doc_id, 2 - coalesce(toxic, 0) AS rel FROM (SELECT query_id, doc_id FROM bm25 UNION SELECT query_id, doc_id FROM keyword) JOIN labels USING (doc_id) WHERE quality = 1),
gained AS (SELECT b.query_id, b.rank, coalesce(rel, 0) AS rel FROM bm25 b LEFT JOIN gold USING (query_id, doc_id) WHERE rank <= 10),
found AS (SELECT query_id, sum(rel / log2(rank + 1.0::DOUBLE)) AS dcg, max(CASE WHEN rank <= 5 AND rel >= 1 THEN 1 ELSE 0 END) AS hit, min(CASE WHEN rel >= 1 THEN rank END) AS first_rank FROM gained GROUP BY query_id),
ideal AS (SELECT query_id, sum(rel / log2(n + 1.0::DOUBLE)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM gold) WHERE n <= 10 GROUP BY query_id),
scores AS (SELECT query_id, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg, coalesce(hit, 0) AS hit, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr FROM ideal LEFT JOIN found USING (query_id)),
categories AS (SELECT *, (['recall', 'temporal', 'entity', 'conceptual', 'multi_hop', 'procedural'])[query_id % 6 + 1] AS category FROM scores),
means AS (SELECT category, avg(ndcg) AS mean FROM categories GROUP BY category)"""


def retrieval_metrics(spark, sf_dir):
    found = _legs(spark, sf_dir)
    return E.metrics(found[0], _gold(spark, sf_dir, found))


def _categories(spark, sf_dir, leg=0):
    names = F.array(*[F.lit(x) for x in WEIGHTS])
    found = _legs(spark, sf_dir)
    scores = E.metrics(found[leg], _gold(spark, sf_dir, found))
    return scores.withColumn("category", F.element_at(names, (F.col("query_id") % 6 + 1).cast("int")))


def category_weighted_total(spark, sf_dir):
    total = E.weighted_total(_categories(spark, sf_dir), WEIGHTS)
    return total.select(F.round("total", 5).alias("total"), *[(F.col("total") >= least).alias(name) for name, least in E.PHASES.items()])


def baseline_compare(spark, sf_dir):
    """The categories of this run against a baseline of fixed means."""
    baseline = spark.createDataFrame([(name, 0.3 + 0.1 * k) for k, name in enumerate(WEIGHTS)], "category string, mean double")
    current = _categories(spark, sf_dir).groupBy("category").agg(F.avg("ndcg").alias("mean"))
    return E.compare(baseline, current).select("category", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"), F.round("delta", 5).alias("delta"), "verdict")


def pooled_results(spark, sf_dir):
    bm25, keyword = _legs(spark, sf_dir)
    return E.pool({"bm25": bm25, "keyword": keyword}, 10)


def latency_stats(spark, sf_dir):
    return E.latency(table(spark, sf_dir, "events"), "event_type", "value")


def mean_concurrency(spark, sf_dir):
    """Time in events over the time that each type's events span."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.sum("value") / (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))), 6).alias("concurrency"), F.count("*").alias("n"))


def largest_remainder(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("w"))
    return E.largest_remainder(groups, 1000, "w", "source")


def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    shares = E.largest_remainder(docs.groupBy("lang").agg(F.count("*").alias("w")), 50, "w", "lang")
    return E.stratified(docs.select("doc_id", "lang"), shares, "lang", "doc_id")


def majority_votes(spark, sf_dir):
    """Several users' graded events as votes on each hour."""
    votes = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), (F.col("value").cast("int") % 5 - 1).alias("grade"))
    return E.majority(votes, ["hour"])


def recall_gate(spark, sf_dir):
    """Each day's share of events that aren't errors against the day before."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("day")).agg(
        F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("score"))
    return E.against_last(daily, "user", "day", "score")


def events_tumbling(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "15 minutes")


def events_session(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "30 minutes")


def top_values(spark, sf_dir):
    """The 15 commonest whole values of events."""
    return table(spark, sf_dir, "events").groupBy(F.floor("value").alias("whole")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "whole").limit(15)


def _dated(spark, sf_dir):
    """Documents dated by events, and passages' first six words asked for on a day, or in its month, or on a day long gone."""
    days = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    chunks = table(spark, sf_dir, "documents").join(days, F.col("doc_id") == F.col("event_id")).select(F.col("doc_id").alias("chunk_id"), "text", F.col("day").alias("chunk_date"))
    said = F.when(F.col("query_id") % 5 == 0, F.lit("1999-01-01")).when(F.col("query_id") % 2 == 0, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy-MM"))
    asked = queries(spark, sf_dir).join(days, F.col("query_id") == F.col("event_id")).select("query_id", first_words(F.col("text"), 6).alias("text"), said.alias("said"))
    return chunks, asked


def timeline_topk(spark, sf_dir):
    """The best documents of each query's time, or of all where that has none; documents are stored by day."""
    chunks, asked = _dated(spark, sf_dir)
    path = new_path(spark, "days")
    write_chunks(chunks, path)
    stored = spark.read.schema("chunk_id long, text string, chunk_date date").parquet(path)
    other = document_index(spark, sf_dir).search(asked.select("query_id", "text"))
    return timeline(asked.select("query_id", F.concat_ws(" ", "text", "said").alias("text"), F.lit("2026-01-01").cast("date").alias("as_of")), stored, other)


def drift_report(spark, sf_dir):
    """Users as workloads, their events in order as iterations, values as times and kinds as results."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("workload"), "event_id", (F.col("value") * 10).alias("ms"), F.col("event_type").alias("signature"))
    runs = e.withColumn("iteration", F.row_number().over(Window.partitionBy("workload").orderBy("event_id")))
    found = E.drift_gates(runs)
    return found.select("workload", "kind", "iteration", *[F.round(c, 6).alias(c) for c in ("baseline", "value", "slope")])


def path_overlaps(spark, sf_dir):
    """Paths of lines, some below others of the same part: how many overlap, by kind."""
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    path = F.when(F.col("l_linenumber") == 1, F.concat_ws("/", "l_partkey", "l_orderkey")).otherwise(F.concat_ws("/", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber"))
    return C.overlapping_paths(line.select("name", path.alias("path"))).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


QUERIES = {
    "timeline_topk": timeline_topk, "drift_report": drift_report, "path_overlaps": path_overlaps,
    "retrieval_metrics": retrieval_metrics, "category_weighted_total": category_weighted_total, "baseline_compare": baseline_compare,
    "pooled_results": pooled_results, "latency_stats": latency_stats, "mean_concurrency": mean_concurrency, "largest_remainder": largest_remainder,
    "stratified_sample": stratified_sample, "majority_votes": majority_votes, "recall_gate": recall_gate, "events_tumbling": events_tumbling,
    "events_session": events_session, "top_values": top_values,
}
_W = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())
_PLACE = "greatest(1, least(len(v), CAST(round_even(len(v) * {p} / 100.0::DOUBLE, 0) AS BIGINT)))"
ORACLE_SQL = {
    "timeline_topk": f"""WITH days AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events),
asked_text AS (
  SELECT item_id AS query_id, array_to_string({_WORDS}[1:6], ' ') AS text,
         CASE WHEN item_id % 5 = 0 THEN DATE '1999-01-01' WHEN item_id % 2 = 0 THEN day ELSE date_trunc('month', day)::DATE END AS lo,
         CASE WHEN item_id % 5 = 0 THEN DATE '1999-01-01' WHEN item_id % 2 = 0 THEN day ELSE last_day(day) END AS hi
  FROM benchmark JOIN days ON event_id = item_id),
asked_terms AS (SELECT DISTINCT query_id, unnest({_tokens('text')}) AS term FROM asked_text),
near AS (SELECT q.query_id, d.doc_id AS chunk_id, {_tokens('d.text')} AS terms FROM asked_text q JOIN days ON day BETWEEN lo AND hi JOIN documents d ON d.doc_id = event_id),
totals_near AS (SELECT query_id, count(*) AS n, avg(len(terms)) AS mean FROM near GROUP BY query_id),
tf_near AS (SELECT query_id, chunk_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT query_id, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM near) GROUP BY query_id, chunk_id, term),
df_near AS (SELECT query_id, term, count(*) AS df FROM tf_near GROUP BY query_id, term),
scored_near AS (
  SELECT query_id, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM tf_near JOIN asked_terms USING (query_id, term) JOIN df_near USING (query_id, term) JOIN totals_near USING (query_id) GROUP BY query_id, chunk_id),
best_near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored_near) WHERE rank <= 10),
{bm25_sql('SELECT query_id, text FROM asked_text')}
SELECT query_id, chunk_id, score, rank, false AS fell_back FROM best_near
UNION ALL SELECT query_id, doc_id, score, rank, true FROM bm25 WHERE query_id NOT IN (SELECT query_id FROM best_near)""",
    "drift_report": """WITH runs AS (
  SELECT CAST(user_id AS VARCHAR) AS workload, value * 10 AS ms, event_type AS signature, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iteration FROM events),
base AS (
  SELECT workload, max(ms) FILTER (iteration = 1) AS b_ms, max(signature) FILTER (iteration = 1) AS b_sig, regr_slope(ms, iteration) AS slope FROM runs GROUP BY workload),
later AS (SELECT r.*, b_ms, b_sig, slope FROM runs r JOIN base USING (workload) WHERE iteration > 1),
slow AS (SELECT workload, iteration, b_ms, ms, slope, row_number() OVER (PARTITION BY workload ORDER BY iteration) AS k FROM later WHERE b_ms >= 100 AND ms > b_ms * 1.5)
SELECT workload, 'time_drift' AS kind, iteration, round(b_ms, 6) AS baseline, round(ms, 6) AS value, round(slope, 6) AS slope FROM slow WHERE k = 1
UNION ALL SELECT workload, 'signature_mismatch', min(iteration), NULL, NULL, NULL FROM later WHERE signature IS DISTINCT FROM b_sig GROUP BY workload""",
    "path_overlaps": """WITH p AS (
  SELECT l_orderkey || '-' || l_linenumber AS name,
         CASE WHEN l_linenumber = 1 THEN l_partkey || '/' || l_orderkey ELSE l_partkey || '/' || l_orderkey || '/' || l_suppkey || '/' || l_linenumber END AS path,
         l_partkey || '/' || l_orderkey AS top FROM lineitem),
met AS (SELECT a.name, 'overlaps' AS kind FROM p a JOIN p b ON b.path = a.top AND a.path <> b.path
  UNION ALL SELECT a.name, 'duplicates' FROM p a JOIN p b ON a.path = b.path AND b.name < a.name)
SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM met GROUP BY kind""",
    "retrieval_metrics": f"WITH {_GOLD} SELECT * FROM scores",
    "category_weighted_total": f"""WITH {_GOLD}, total AS (SELECT round(sum(mean * w) / 1.0::DOUBLE, 6) AS total FROM means JOIN (VALUES {_W}) t(category, w) USING (category))
SELECT round(total, 5) AS total, {', '.join(f'total >= {v} AS {k}' for k, v in E.PHASES.items())} FROM total""",
    "baseline_compare": f"""WITH {_GOLD}, base AS (SELECT * FROM (VALUES {', '.join(f"('{name}', 0.3::DOUBLE + 0.1::DOUBLE * {k})" for k, name in enumerate(WEIGHTS))}) t(category, before)),
both_runs AS (SELECT category, coalesce(before, 0) AS a, coalesce(mean, 0) AS b FROM base FULL JOIN means USING (category))
SELECT category, round(a, 5) AS before, round(b, 5) AS after, round(round(b - a, 6), 5) AS delta,
  CASE WHEN b < 0.5 AND NOT (a = 0 AND b = 0) THEN 'fail' WHEN b - a < -0.01 THEN 'warn' ELSE 'pass' END AS verdict FROM both_runs""",
    "pooled_results": f"""WITH {bm25_sql(_Q, k=20)}, {KEYWORD}, pooled AS (SELECT query_id, doc_id, 'bm25' AS s FROM bm25 WHERE rank <= 10 UNION SELECT query_id, doc_id, 'keyword' FROM keyword WHERE rank <= 10)
SELECT query_id, doc_id, string_agg(s, ',' ORDER BY s) AS systems FROM pooled GROUP BY query_id, doc_id""",
    "latency_stats": f"""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS n, round(v[1], 1) AS least, round(v[-1], 1) AS most, round(list_sum(v) / len(v), 1) AS mean,
  {', '.join(f"round(v[{_PLACE.format(p=p)}], 1) AS p{p}" for p in (50, 95, 99))} FROM s""",
    "mean_concurrency": "SELECT event_type, round(sum(value) / (floor(epoch(max(ts))) - floor(epoch(min(ts)))), 6) AS concurrency, count(*) AS n FROM events GROUP BY event_type",
    "largest_remainder": """WITH x AS (SELECT source, sum(n_chars) * 1000.0::DOUBLE / sum(sum(n_chars)) OVER () AS x FROM documents GROUP BY source),
r AS (SELECT source, CAST(floor(x) AS BIGINT) AS whole, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS n FROM x)
SELECT source, whole + CASE WHEN n <= 1000 - sum(whole) OVER () THEN 1 ELSE 0 END AS share FROM r""",
    "stratified_sample": """WITH x AS (SELECT lang, count(*) * 50.0::DOUBLE / sum(count(*)) OVER () AS x FROM documents GROUP BY lang),
r AS (SELECT lang, CAST(floor(x) AS BIGINT) AS whole, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS n FROM x),
shares AS (SELECT lang, whole + CASE WHEN n <= 50 - sum(whole) OVER () THEN 1 ELSE 0 END AS share FROM r),
placed AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents)
SELECT doc_id, lang FROM placed JOIN shares USING (lang) WHERE n <= share""",
    "majority_votes": """WITH votes AS (SELECT date_trunc('hour', ts) AS hour, greatest(0, least(2, CAST(trunc(value) AS INT) % 5 - 1)) AS grade FROM events),
counts AS (SELECT hour, grade, count(*) AS n FROM votes GROUP BY 1, 2)
SELECT hour, arg_min(grade, -n * 10 + grade) AS grade, CAST(sum(n) AS BIGINT) AS votes FROM counts GROUP BY hour""",
    "recall_gate": """WITH daily AS (SELECT user_id AS "user", ts::DATE AS day, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS score FROM events GROUP BY 1, 2),
b AS (SELECT *, lag(score) OVER (PARTITION BY "user" ORDER BY day) AS before FROM daily)
SELECT *, before IS NULL OR score >= before * (1 - 0.1::DOUBLE) AS passed FROM b""",
    "events_tumbling": """SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "events_session": """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS starts FROM events),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM numbered GROUP BY user_id, s""",
    "top_values": "SELECT CAST(floor(value) AS BIGINT) AS whole, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, whole LIMIT 15",
}
