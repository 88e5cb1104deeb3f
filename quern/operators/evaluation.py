"""Retrieval metrics, gates against a baseline, latency figures and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import cut, small

#: Verdicts of a run by its weighted total, and of categories (fixed values).
PHASES = {"phase1": 0.62, "phase2": 0.68, "phase3": 0.75}
MOST_DROP, LEAST_CATEGORY, WARN_DROP = 0.02, 0.50, -0.01


def gains(ranked: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ranked`` (query_id, key, rank) with the relevance ``rel`` of each result, 0 if it isn't in ``gold`` (query_id, key, rel)."""
    return ranked.join(gold, ["query_id", key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics(ranked: DataFrame, gold: DataFrame, k: int = 10, hit: int = 5, key: str = "doc_id") -> DataFrame:
    """(query_id, ndcg, hit, mrr) of each query that has gold results; 0 for queries without results.

    Results are counted in order of rank up to ``k`` (``hit`` for hits); the ideal order is that of the gold relevances.
    """
    found = gains(ranked, gold, key).where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.max(F.when((F.col("rank") <= hit) & (F.col("rel") >= 1), 1).otherwise(0)).alias("hit"),
        F.min(F.when(F.col("rel") >= 1, F.col("rank"))).alias("first"),
    )
    best = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), key)
    ideal = (
        gold.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
        .groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("_n") + 1.0)).alias("idcg"))
    )
    joined = ideal.join(found, "query_id", "left")
    return joined.select(
        "query_id", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        F.coalesce("hit", F.lit(0)).alias("hit"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def weighted_total(scores: DataFrame, weights: dict[str, float], value: str = "ndcg") -> DataFrame:
    """(total): the weighted mean of category means; a category without cases counts 0."""
    by = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    means = scores.groupBy("category").agg(F.avg(value).alias("mean"))
    return means.agg(F.round(F.sum(F.col("mean") * F.coalesce(by[F.col("category")], F.lit(0.0))) / float(sum(weights.values())), 6).alias("total"))


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(category, before, after, delta, verdict) of category means: fail under the least unless both are 0, warn on a drop."""
    both = baseline.select("category", F.col("mean").alias("before")).join(current.select("category", F.col("mean").alias("after")), "category", "full_outer")
    a, b = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    verdict = F.when((b < LEAST_CATEGORY) & ~((a == 0) & (b == 0)), "fail").when(b - a < WARN_DROP, "warn").otherwise("pass")
    return both.select("category", F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(b - a, 6).alias("delta"), verdict.alias("verdict"))


def ranked_percentile(values: Column, p: int) -> Column:
    """The value whose place is ``p`` per cent of the count, rounded half to even, from 1 on; ``values`` is sorted."""
    n = F.size(values)
    return F.element_at(values, F.greatest(F.lit(1), F.least(n, F.bround(n * p / 100).cast("int"))))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, mean, largest and p50, p95, p99 of each group, to one decimal.

    Places are exact at any size: values are counted and ranged into blocks first; running counts are made in a block and
    begin with the sum of the blocks before, so no task sorts a whole group.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(by, value).withColumn("_block", F.spark_partition_id()))
    blocks = Window.partitionBy(by).orderBy("_block")
    before = ranged.groupBy(by, "_block").agg(F.sum("_c").alias("_sum")).select(
        F.col(by).alias("_by"), F.col("_block").alias("_own"), (F.sum("_sum").over(blocks) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(by)).alias("_n"))
    joined = ranged.join(small(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_own")))
    held = joined.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(by, "_block").orderBy(value)))
    place = lambda p: F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.col("_n") * p / 100).cast("long")))
    at = lambda p: F.round(F.min(F.when(F.col("_to") >= place(p), F.col(value))), 1)
    return held.groupBy(by).agg(
        F.sum("_c").alias("n"), F.round(F.min(value), 1).alias("least"), F.round(F.max(value), 1).alias("most"),
        F.round(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), 1).alias("mean"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"),
    )


def largest_remainder(groups: DataFrame, total: int, weight: str, key: str) -> DataFrame:
    """(key, share): ``total`` places by weight, whole parts first, then one each to the largest rests (ties by key)."""
    every = Window.partitionBy()
    exact = groups.withColumn("_x", F.col(weight) * total / F.sum(weight).over(every)).withColumn("_whole", F.floor("_x"))
    order = Window.orderBy(F.round(F.col("_x") - F.col("_whole"), 9).desc(), key)
    more = F.row_number().over(order) <= total - F.sum("_whole").over(every)
    return exact.select(key, (F.col("_whole") + more.cast("long")).alias("share"))


#: Rows of the same first digits of their hash that are ranked one by one at most.
FEW = 10_000


def stratified(rows: DataFrame, shares: DataFrame, by: str, key: str) -> DataFrame:
    """So many rows of each group as its share, those with the smallest hash of their key; the same in every run.

    No group is sorted. Rows are counted by the first three digits of their hash, and the digits are found within which the share
    ends; only those are counted again by three digits more, until few rows are left, or no digits. All rows of smaller
    digits are taken, and of those few the first.
    """
    hashed = rows.withColumn("_h", F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")))
    edges = shares.where(F.col("share") > 0).select(by, F.lit("").alias("_prefix"), F.col("share").cast("long").alias("_rest"))
    for digits in range(0, 32, 3):
        inside = hashed.select(by, "_h").join(edges, by).where(F.startswith("_h", "_prefix"))
        counts = inside.groupBy(by, "_prefix", "_rest", F.substring(F.col("_h"), F.lit(digits + 1), F.lit(3)).alias("_next")).agg(F.count("*").alias("_n"))
        so_far = F.sum("_n").over(Window.partitionBy(by).orderBy("_next"))  # at most 4097 rows a group
        ends = counts.withColumn("_to", so_far).where(F.col("_to") >= F.col("_rest"))
        first = ends.groupBy(by).agg(F.min_by(F.struct(F.concat("_prefix", "_next").alias("_prefix"), (F.col("_rest") - F.col("_to") + F.col("_n")).alias("_rest"), "_n"), "_next").alias("_e"))
        # a group that ends before its share is taken whole: no digit is larger than g
        edges = cut(edges.select(by).join(first, by, "left").select(by, F.coalesce("_e._prefix", F.lit("g")).alias("_prefix"), F.coalesce("_e._rest", F.lit(0)).alias("_rest"), F.coalesce("_e._n", F.lit(0)).alias("_n")))
        if (edges.agg(F.max("_n")).first()[0] or 0) <= FEW:
            break
        edges = edges.drop("_n")
    placed = hashed.join(edges.select(by, "_prefix", "_rest"), by)
    here = F.startswith("_h", "_prefix")
    few = placed.where(here).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).where(F.col("_k") <= F.col("_rest"))
    return placed.where(~here & (F.col("_h") < F.col("_prefix"))).select(*rows.columns).unionByName(few.select(*rows.columns))


def majority(votes: DataFrame, by: list[str], grade: str = "grade") -> DataFrame:
    """The commonest grade of each case, the smaller of equals, held to 0, 1 and 2."""
    held = votes.withColumn(grade, F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(grade, F.lit(0)))))
    counts = held.groupBy(*by, grade).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by(grade, F.struct("n", -F.col(grade))).alias(grade), F.sum("n").alias("votes"))


def pool(legs: dict[str, DataFrame], k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key, systems): what any system has among its first ``k``, with the systems' names."""
    every = None
    for name, leg in legs.items():
        own = leg.where(F.col("rank") <= k).select("query_id", key, F.lit(name).alias("system"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("query_id", key).agg(F.array_join(F.sort_array(F.collect_set("system")), ",").alias("systems"))


def against_last(runs: DataFrame, by: str, order: str, value: str, most_drop: float = 0.1) -> DataFrame:
    """Each run with the one before and whether it fell by more than ``most_drop`` of it; the first passes."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(value).over(w)
    return runs.withColumn("before", before).withColumn("passed", before.isNull() | (F.col(value) >= before * (1 - most_drop)))


def regression(baseline: DataFrame, current: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: both weighted totals of (category, mean), their difference, and whether the run passes.

    It fails if the total drops by more than MOST_DROP or a category lies under LEAST_CATEGORY (unless both runs have 0
    there); categories that drop by more than WARN_DROP are named.
    """
    cases = compare(baseline, current)
    total = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[F.col("category")]
    names = lambda v: F.array_join(F.sort_array(F.collect_list(F.when(F.col("verdict") == v, F.col("category")))), ",")
    summed = lambda c: F.round(F.sum(F.col(c) * F.coalesce(total, F.lit(0.0))) / float(sum(weights.values())), 4)
    row = cases.agg(summed("before").alias("baseline_score"), summed("after").alias("current_score"), names("warn").alias("category_warns"), names("fail").alias("category_fails"))
    delta = F.col("current_score") - F.col("baseline_score")
    return row.select(
        "baseline_score", "current_score", F.round(delta, 4).alias("overall_delta"), (delta < -MOST_DROP).alias("regression"), "category_warns", "category_fails",
        (~(delta < -MOST_DROP) & (F.col("category_fails") == "")).alias("passed"),
    )


#: What to do about a weak category, and the hint about the corpus that it needs.
ADVICE = [
    ("temporal", "enable the date boost", "temporal"), ("procedural", "extend the procedural patterns", "procedural"), ("entity", "raise the entity boost", "entity"),
    ("conceptual", "fuse by reciprocal ranks", None), ("recall", "give documents telling titles", None),
]


def quality_gate(scores: DataFrame, hints: set[str], floor: float = LEAST_CATEGORY) -> DataFrame:
    """(category, score, weak, recommendation, verdict): hold if any category lies under the floor, with advice that the hints allow."""
    advice = F.create_map(*[F.lit(x) for c, text, hint in ADVICE if hint is None or hint in hints for x in (c, text)])
    weak = F.col("score") < floor
    held = F.max(weak.cast("int")).over(Window.partitionBy()) == 1
    return scores.select("category", "score", weak.alias("weak"), F.when(weak, advice[F.col("category")]).alias("recommendation"), F.when(held, "hold").otherwise("pass").alias("verdict"))


#: Least scores by category (fixed values).
REPORTER_GATES = {"overall": 0.78, "temporal": 0.55, "entity": 0.80, "contextual_prep": 0.60}


def gate_failures(scores: DataFrame, gates: dict[str, float] = REPORTER_GATES) -> DataFrame:
    """(category, score, gate) of gates that aren't reached; a category without a score has 0."""
    asked = scores.sparkSession.createDataFrame(list(gates.items()), "category string, gate double")
    joined = asked.join(scores.select("category", "score"), "category", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return joined.where(F.col("score") < F.col("gate")).select("category", "score", "gate")


def monitor(runs: DataFrame, by: str, order: str, most_drop: float = MOST_DROP) -> DataFrame:
    """Runs with the first one's score as baseline, their drop from it, and all failed vectors so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("score").over(w)
    return runs.select(
        by, order, "score", "vec_failed", base.alias("baseline"), F.round(F.col("score") - base, 6).alias("drop"), (F.col("score") - base < -most_drop).alias("regression"),
        F.sum("vec_failed").over(w).alias("failed_so_far"),
    )


def bottleneck(p95: Column, mean_concurrency: Column, requested: Column, threshold: Column, throttled: Column) -> Column:
    """The likeliest cause of a slow probe; null for a healthy one."""
    return (
        F.when(throttled > 0, "rate_limit").when((requested >= 5) & (mean_concurrency < requested * 0.6), "worker_contention")
        .when((p95 > threshold) & (requested <= 2), "deployment_or_network").when(p95 > threshold, "pool_or_cache")
    )


def query_quotas(profiles: DataFrame, n: int = 50) -> DataFrame:
    """(…, category, quota): ``n`` test queries shared by what a corpus holds.

    ``profiles`` has total, procedural, dated and entities counts; its other columns are kept.
    """
    ratio = lambda c, most: F.least(F.col(c) / F.greatest(F.col("total"), F.lit(1)), F.lit(most))
    share = lambda least, floor, x: F.greatest(F.lit(least), F.floor(F.lit(n) * F.greatest(F.lit(floor), x)).cast("int"))
    quotas = {
        "recall": F.lit(max(3, int(n * 0.30))), "conceptual": F.lit(max(2, int(n * 0.15))), "procedural": share(2, 0.10, ratio("procedural", 0.3)),
        "temporal": share(1, 0.05, ratio("dated", 0.3) * 0.5), "entity": share(1, 0.05, ratio("entities", 0.2) * 0.5),
    }
    rest = F.lit(n)
    for x in quotas.values():
        rest = rest - x
    quotas["multi_hop"] = F.greatest(F.lit(1), rest)
    keep = [c for c in profiles.columns if c not in ("total", "procedural", "dated", "entities")]
    return profiles.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("category"), x.cast("int").alias("quota")) for c, x in quotas.items()])))


#: How a title is asked for in each category; conceptual queries take the titles after those of recall.
TEMPLATES = {"recall": "", "conceptual": "explain the concept of ", "procedural": "how to ", "temporal": "recent changes to ", "entity": "tell me about "}


def template_queries(titles: DataFrame, quotas: DataFrame, by: str) -> DataFrame:
    """(by, category, number, query): the first titles (by, title, place) of each group in the words of each category."""
    recall = quotas.where(F.col("category") == "recall").select(by, F.col("quota").alias("_recall"))
    asked = quotas.where(F.col("category").isin(list(TEMPLATES))).join(recall, by)
    skip = F.when(F.col("category") == "conceptual", F.col("_recall")).otherwise(0)
    words = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    met = titles.join(small(asked), by).where((F.col("place") > skip) & (F.col("place") <= skip + F.col("quota")))
    return met.select(by, "category", (F.col("place") - skip).alias("number"), F.concat(words[F.col("category")], F.regexp_replace("title", "[-_]", " ")).alias("query"))


def contradictions(scored: DataFrame, least: float = 0.45, scores: tuple[str, ...] = ("direct", "overstatement", "status_mismatch")) -> DataFrame:
    """(doc, claim, path, score, category, rank): candidates that speak against a document's claims, the worst first.

    ``scored`` is (doc, claim, path, one column a category). Of a path the first claim counts (of its rows the one of the smallest scores). The category is that of the
    largest score, the first of equals; none where all are 0.
    """
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "path").orderBy("claim", *scores))).where(F.col("_n") == 1)
    best = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    category = F.when(best <= 0, "")
    for c in scores:
        category = category.when(F.col(c) == best, c)
    kept = first.select("doc", "claim", "path", best.alias("score"), category.alias("category")).where(F.col("score") >= least)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("score").desc(), "path")))


def drift_gates(runs: DataFrame, most: float = 0.5, floor: float = 100.0) -> DataFrame:
    """(workload, kind, iteration, baseline, value, slope): the first iteration at which a repeated workload fails a gate.

    ``runs`` are (workload, iteration, ms, signature). The first iteration is the baseline. ``time_drift`` is a later one that takes
    over ``1 + most`` times as long, unless the baseline is below ``floor``, where noise rules; ``slope`` is the growth an iteration by
    least squares. ``signature_mismatch`` is a later one with another result. One row a workload and gate that fails; times
    are null for signatures. Of an iteration that is there twice the smallest time and signature count; a null time fails nothing.
    """
    each = runs.groupBy("workload", "iteration").agg(F.min("ms").alias("ms"), F.min("signature").alias("signature"))
    first = each.groupBy("workload").agg(F.min_by(F.struct("iteration", "ms", "signature"), "iteration").alias("_b"), F.regr_slope("ms", "iteration").alias("slope"))
    later = each.join(first, "workload").where(F.col("iteration") > F.col("_b.iteration"))
    slow = later.where((F.col("_b.ms") >= floor) & (F.col("ms") > F.col("_b.ms") * (1 + most)))
    slow = slow.groupBy("workload").agg(F.min_by(F.struct("iteration", F.col("_b.ms").alias("baseline"), F.col("ms").alias("value"), "slope"), "iteration").alias("_r"))
    other = later.where(~F.col("signature").eqNullSafe(F.col("_b.signature"))).groupBy("workload").agg(F.min("iteration").alias("iteration"))
    none = F.lit(None).cast("double")
    return slow.select("workload", F.lit("time_drift").alias("kind"), "_r.iteration", "_r.baseline", "_r.value", "_r.slope").unionByName(
        other.select("workload", F.lit("signature_mismatch").alias("kind"), "iteration", none.alias("baseline"), none.alias("value"), none.alias("slope")))
