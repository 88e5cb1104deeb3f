"""Queries over gold lists, gates, recommendations and probes, with their SQL. Lists are made from the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluation as E
from quern.operators import matching as M
from quern.plans.tables import table
from quern.shared import cut


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))


def _results(spark, sf_dir):
    """Each customer's orders, the dearest first, as paths of which some repeat."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    name = F.concat(F.lit("Order_"), (F.col("o_orderkey") % 23).cast("string"), F.lit(".md"))
    path = F.concat_ws("/", F.lit("Store"), F.lower("o_orderstatus"), F.regexp_replace("o_orderpriority", " ", "_"), name)
    return o.select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).alias("rank"), path.alias("path"))


def _gold(spark, sf_dir):
    """Of each third customer nothing, of others a title, a path's end and a title with its suffix."""
    k = F.col("c_custkey")
    num = lambda n: (k * n % 23).cast("string")
    entry = lambda pos, ref, rel: F.struct(F.lit(pos).alias("pos"), ref.alias("ref"), rel.cast("int").alias("rel"))
    refs = F.array(
        entry(1, F.concat(F.lit("order "), num(3)), k % 3), entry(2, F.concat(F.lit("1-URGENT/order-"), num(5)), k % 2 + 1), entry(3, F.concat(F.lit("Order_"), num(3), F.lit(".md")), F.lit(2)),
        entry(4, F.concat(F.lit("Order-"), num(7)), F.lit(1)))
    return table(spark, sf_dir, "customer").where(k % 3 != 0).select(k.alias("query_id"), F.inline(refs))


def graded_metrics(spark, sf_dir):
    return M.graded(_asked(spark, sf_dir), _results(spark, sf_dir), _gold(spark, sf_dir))


def _gold_paths(spark, sf_dir):
    path = F.concat(F.lit("STORE\\o/"), F.element_at(F.array(*[F.lit(x) for x in ("1-urgent", "2-high", "3-medium")]), (F.col("pos") % 3 + 1).cast("int")), F.lit("/Order_"), (F.col("query_id") * 5 % 23).cast("string"), F.lit(".md"))
    return _gold(spark, sf_dir).select("query_id", path.alias("path"))


def binary_metrics(spark, sf_dir):
    return M.binary(_asked(spark, sf_dir), _results(spark, sf_dir), _gold_paths(spark, sf_dir))


def substring_scores(spark, sf_dir):
    return M.substring_scores(_asked(spark, sf_dir), _results(spark, sf_dir), _gold(spark, sf_dir))


CATEGORIES = ["recall", "temporal", "entity", "conceptual", "multi_hop", "procedural"]


def _runs(spark, sf_dir):
    """A score of each category and day: the share of events that aren't errors, of a part of the users."""
    names = F.array(*[F.lit(x) for x in CATEGORIES])
    e = table(spark, sf_dir, "events").withColumn("category", F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")))
    good = F.when(F.col("event_type") == "error", 0.0).when(F.col("category") == "entity", 0.45).otherwise(1.0)
    return e.groupBy("category", F.to_date("ts").alias("day")).agg(F.round(F.avg(good), 4).alias("score"), F.count_if(F.col("event_type") == "error").alias("vec_failed"))


def _means(spark, sf_dir, first):
    days = F.day("day") <= 15 if first else F.day("day") > 15
    return _runs(spark, sf_dir).where(days).groupBy("category").agg(F.round(F.avg("score"), 4).alias("mean"))


def regression_gate(spark, sf_dir):
    """The later half of the runs against the earlier one."""
    return E.regression(_means(spark, sf_dir, True), _means(spark, sf_dir, False), dict.fromkeys(CATEGORIES, 1.0))


def quality_gate(spark, sf_dir):
    hints = {"temporal", "entity"}
    return E.quality_gate(_means(spark, sf_dir, False).withColumnRenamed("mean", "score"), hints, 0.95)


def reporter_gates(spark, sf_dir):
    return E.gate_failures(_means(spark, sf_dir, False).withColumnRenamed("mean", "score"))


def run_monitor(spark, sf_dir):
    return E.monitor(_runs(spark, sf_dir), "category", "day")


def bottlenecks(spark, sf_dir):
    """Each user's events as a probe."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.max("value"), 1).alias("p95"), F.round(F.avg("value") / 10, 2).alias("mean_concurrency"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 95)).alias("throttled"))
    probes = e.withColumn("requested", (F.col("user_id") % 12).cast("int"))
    return probes.select("user_id", E.bottleneck(F.col("p95"), F.col("mean_concurrency"), F.col("requested"), F.lit(80.0), F.col("throttled")).alias("bottleneck"))


def query_quotas(spark, sf_dir):
    """How many test queries of each category a collection's documents ask for."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("doc_id") % 5 == 0).alias("procedural"), F.count_if(F.col("lang") == "de").alias("dated"), F.count_if(F.col("lang") == "fr").alias("entities"))
    return E.query_quotas(d, 50)


def template_queries(spark, sf_dir):
    """Test queries of each collection from its documents' numbers as titles."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("the_title-"), F.col("doc_id").cast("string")).alias("title"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    quotas = cut(query_quotas(spark, sf_dir))
    # a category takes its quota of titles, or the recall's and its own
    most = 2 * (quotas.agg(F.max("quota")).first()[0] or 0)
    return E.template_queries(docs.withColumn("place", place).where(F.col("place") <= most), quotas, "source")


def contradictions(spark, sf_dir):
    """Claims (lines of orders) against candidates (parts) with three scores each."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("claim"), (F.col("l_partkey") % 40).cast("string").alias("path"),
        *[(F.col(c).cast("double") / m).alias(n) for c, m, n in (("l_quantity", 60.0, "direct"), ("l_discount", 0.12, "overstatement"), ("l_tax", 0.1, "status_mismatch"))])
    return E.contradictions(l)


QUERIES = {
    "graded_metrics": graded_metrics, "binary_metrics": binary_metrics, "substring_scores": substring_scores, "regression_gate": regression_gate,
    "quality_gate": quality_gate, "reporter_gates": reporter_gates, "run_monitor": run_monitor, "bottlenecks": bottlenecks,
    "query_quotas": query_quotas, "template_queries": template_queries, "contradictions": contradictions,
}

_KEY = lambda c: f"trim(regexp_replace(lower({c}), '[-_\\s]+', '-', 'g'), '-')"
_LISTS = f"""asked AS (SELECT c_custkey AS query_id FROM customer),
results AS (
  SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
         'Store/' || lower(o_orderstatus) || '/' || replace(o_orderpriority, ' ', '_') || '/Order_' || (o_orderkey % 23) || '.md' AS path FROM orders),
gold AS (
  SELECT query_id, unnest([1, 2, 3, 4]) AS pos, unnest(['order ' || (query_id * 3 % 23), '1-URGENT/order-' || (query_id * 5 % 23), 'Order_' || (query_id * 3 % 23) || '.md', 'Order-' || (query_id * 7 % 23)]) AS ref,
         unnest([query_id % 3, query_id % 2 + 1, 2, 1]) AS rel FROM asked WHERE query_id % 3 <> 0),
once AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM results GROUP BY query_id, path)"""
_MEANS = """runs AS (
  SELECT category, ts::DATE AS day, round(avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE WHEN category = 'entity' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END), 4) AS score, count(*) FILTER (event_type = 'error') AS vec_failed
  FROM (SELECT *, (['recall', 'temporal', 'entity', 'conceptual', 'multi_hop', 'procedural'])[user_id % 6 + 1] AS category FROM events) GROUP BY 1, 2),
early AS (SELECT category, round(avg(score), 4) AS mean FROM runs WHERE day(day) <= 15 GROUP BY 1),
late AS (SELECT category, round(avg(score), 4) AS mean FROM runs WHERE day(day) > 15 GROUP BY 1)"""
_QUOTAS = """quotas AS (
  SELECT source, greatest(3, 15) AS recall, greatest(2, 7) AS conceptual, greatest(2, CAST(floor(50 * greatest(0.10::DOUBLE, least(procedural::DOUBLE / total, 0.3::DOUBLE))) AS INT)) AS procedural,
         greatest(1, CAST(floor(50 * greatest(0.05::DOUBLE, least(dated::DOUBLE / total, 0.3::DOUBLE) * 0.5)) AS INT)) AS temporal, greatest(1, CAST(floor(50 * greatest(0.05::DOUBLE, least(entities::DOUBLE / total, 0.2::DOUBLE) * 0.5)) AS INT)) AS entity
  FROM (SELECT source, count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS procedural, count(*) FILTER (lang = 'de') AS dated, count(*) FILTER (lang = 'fr') AS entities FROM documents GROUP BY source)),
all_quotas AS (SELECT *, greatest(1, 50 - recall - conceptual - procedural - temporal - entity) AS multi_hop FROM quotas)"""
ORACLE_SQL = {
    "graded_metrics": f"""WITH {_LISTS},
pairs AS (
  SELECT o.query_id, o.rank, pos, rel FROM once o JOIN gold g USING (query_id) WHERE o.rank <= 10 AND
    CASE WHEN contains(regexp_replace(ref, '\\.md$', ''), '/') THEN ends_with({_KEY("replace(path, '.md', '')")}, {_KEY("regexp_replace(ref, '\\.md$', '')")})
         ELSE {_KEY("regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')")} = {_KEY("regexp_replace(ref, '\\.md$', '')")} END),
met AS (SELECT query_id, rank, arg_min(rel, pos) AS rel, max(rel) AS best FROM pairs GROUP BY 1, 2),
found AS (SELECT query_id, sum(rel / log2(rank + 1.0::DOUBLE)) AS dcg, max(CASE WHEN rank <= 5 AND best >= 1 THEN 1 ELSE 0 END) AS hit, min(rank) FILTER (best >= 1) AS first_rank FROM met GROUP BY 1),
ideal AS (SELECT query_id, sum(rel / log2(n + 1.0::DOUBLE)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS n FROM gold) WHERE n <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN idcg > 1e-9 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg, coalesce(hit, 0) AS hit, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS rr
FROM asked LEFT JOIN found USING (query_id) LEFT JOIN ideal USING (query_id)""",
    "binary_metrics": f"""WITH {_LISTS},
wanted AS (SELECT query_id, lower(replace('STORE\\o/' || (['1-urgent', '2-high', '3-medium'])[pos % 3 + 1] || '/Order_' || (query_id * 5 % 23) || '.md', '\\', '/')) AS p FROM gold),
gained AS (SELECT query_id, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM once WHERE rank <= 10 AND (query_id, lower(path)) IN (SELECT query_id, p FROM wanted) GROUP BY 1),
seen AS (SELECT query_id, min(rank) AS first_rank FROM results WHERE (query_id, lower(path)) IN (SELECT query_id, p FROM wanted) GROUP BY 1),
ideal AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS idcg FROM wanted GROUP BY query_id)
SELECT query_id, round(CASE WHEN idcg IS NULL THEN 0 ELSE coalesce(dcg, 0) / idcg END, 6) AS ndcg, CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END AS hit, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr
FROM asked LEFT JOIN gained USING (query_id) LEFT JOIN seen USING (query_id) LEFT JOIN ideal USING (query_id)""",
    "substring_scores": f"""WITH {_LISTS}, held AS (SELECT query_id, min(rank) AS f FROM results JOIN gold USING (query_id) WHERE rank <= 10 AND contains(lower(path), lower(ref)) GROUP BY 1)
SELECT query_id, CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END AS exact, CASE WHEN f <= 10 THEN 1.0::DOUBLE ELSE 0 END AS fuzzy FROM asked LEFT JOIN held USING (query_id)""",
    "regression_gate": f"""WITH {_MEANS}, both_runs AS (SELECT category, coalesce(e.mean, 0) AS a, coalesce(l.mean, 0) AS b FROM early e FULL JOIN late l USING (category)),
verdicts AS (SELECT *, round(b - a, 4) AS delta, CASE WHEN b < 0.5 AND NOT (a < 1e-9 AND b < 1e-9) THEN 'fail' WHEN b - a < -0.01 THEN 'warn' ELSE 'pass' END AS verdict FROM both_runs),
totals AS (SELECT round(sum(a) / 6, 4) AS ta, round(sum(b) / 6, 4) AS tb FROM both_runs)
SELECT ta AS baseline_score, tb AS current_score, round(tb - ta, 4) AS overall_delta, tb - ta < -0.02 AS regression,
  coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM verdicts WHERE verdict = 'warn'), '') AS category_warns, coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM verdicts WHERE verdict = 'fail'), '') AS category_fails,
  NOT (tb - ta < -0.02) AND NOT EXISTS (SELECT 1 FROM verdicts WHERE verdict = 'fail') AS passed FROM totals""",
    "quality_gate": f"""WITH {_MEANS}, advice AS (SELECT * FROM (VALUES ('temporal', 'enable the date boost'), ('entity', 'raise the entity boost'), ('conceptual', 'fuse by reciprocal ranks'), ('recall', 'give documents telling titles')) t(category, recommendation))
SELECT category, mean AS score, mean < 0.95 AS weak, CASE WHEN mean < 0.95 THEN recommendation END AS recommendation, CASE WHEN bool_or(mean < 0.95) OVER () THEN 'hold' ELSE 'pass' END AS verdict FROM late LEFT JOIN advice USING (category)""",
    "reporter_gates": f"""WITH {_MEANS} SELECT category, coalesce(mean, 0) AS score, gate FROM (VALUES ('overall', 0.78::DOUBLE), ('temporal', 0.55::DOUBLE), ('entity', 0.80::DOUBLE), ('contextual_prep', 0.60::DOUBLE)) t(category, gate) LEFT JOIN late USING (category)
WHERE coalesce(mean, 0) < gate""",
    "run_monitor": f"""WITH {_MEANS} SELECT category, day, score, vec_failed, first_value(score) OVER w AS baseline, round(score - first_value(score) OVER w, 6) AS drop, score - first_value(score) OVER w < -0.02 AS regression,
  CAST(sum(vec_failed) OVER w AS BIGINT) AS failed_so_far FROM runs WINDOW w AS (PARTITION BY category ORDER BY day)""",
    "bottlenecks": """WITH p AS (SELECT user_id, round(max(value), 1) AS p95, round(avg(value) / 10, 2) AS mc, count(*) FILTER (event_type = 'error' AND value > 95) AS throttled, user_id % 12 AS requested FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN throttled > 0 THEN 'rate_limit' WHEN requested >= 5 AND mc < requested * 0.6::DOUBLE THEN 'worker_contention' WHEN p95 > 80 AND requested <= 2 THEN 'deployment_or_network' WHEN p95 > 80 THEN 'pool_or_cache' END AS bottleneck FROM p""",
    "query_quotas": f"WITH {_QUOTAS} SELECT source, unnest(['recall', 'conceptual', 'procedural', 'temporal', 'entity', 'multi_hop']) AS category, unnest([recall, conceptual, procedural, temporal, entity, multi_hop]) AS quota FROM all_quotas",
    "template_queries": f"""WITH {_QUOTAS}, titles AS (SELECT * FROM (SELECT source, 'the title ' || doc_id AS readable, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)),
each AS (
  SELECT source, place, 'recall' AS category, readable AS query, recall AS n, 0 AS skip FROM titles JOIN all_quotas USING (source)
  UNION ALL SELECT source, place, 'conceptual', 'explain the concept of ' || readable, conceptual, recall FROM titles JOIN all_quotas USING (source)
  UNION ALL SELECT source, place, 'procedural', 'how to ' || readable, procedural, 0 FROM titles JOIN all_quotas USING (source)
  UNION ALL SELECT source, place, 'temporal', 'recent changes to ' || readable, temporal, 0 FROM titles JOIN all_quotas USING (source)
  UNION ALL SELECT source, place, 'entity', 'tell me about ' || readable, entity, 0 FROM titles JOIN all_quotas USING (source))
SELECT source, category, place - skip AS number, query FROM each WHERE place > skip AND place <= skip + n""",
    "contradictions": """WITH s AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INT) AS claim, CAST(l_partkey % 40 AS VARCHAR) AS path, l_quantity::DOUBLE / 60.0::DOUBLE AS a, l_discount::DOUBLE / 0.12::DOUBLE AS b, l_tax::DOUBLE / 0.1::DOUBLE AS c FROM lineitem),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, path ORDER BY claim, a, b, c) AS n FROM s) WHERE n = 1),
best AS (SELECT doc, claim, path, greatest(a, b, c) AS score, CASE WHEN greatest(a, b, c) <= 0 THEN '' WHEN a >= b AND a >= c THEN 'direct' WHEN b >= c THEN 'overstatement' ELSE 'status_mismatch' END AS category FROM one)
SELECT doc, claim, path, score, category, row_number() OVER (PARTITION BY doc ORDER BY score DESC, path) AS rank FROM best WHERE score >= 0.45""",
}
