"""Mixing sources to target weights by nested hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import WORD_RE, cut, small, whole

#: A document's place in its source's order: the first 48 bits of the MD5 of its id.
BITS, LEVEL_BITS = 48, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD_RE)).cast("long")


def place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: tuple[int, int], at_most: int) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, each share at most ``at_most`` times the source.

    Weights repeat over the sources in code point order, null last. Sources in the order of cap over weight are
    full up to the first whose cap exceeds an even share of what is left; all others get that share. The windows
    run over one row per source, in one task: fine for up to some millions of sources.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = total.withColumns({
        "_w": F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"),
        "_cap": F.col("source_size") * at_most,
        "_all": F.sum("source_size").over(every),
    })
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "_left": F.col("_all") * budget[0] - budget[1] * F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_open": F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    full = F.col("_cap") * F.col("_open") * budget[1] <= F.col("_w") * F.col("_left")
    t = t.withColumn("_share", F.when(~full, F.struct(F.col("_cap") / F.col("_w"), "source", "_left", "_open")))
    t = t.withColumn("_share", F.min("_share").over(every))
    shared = (F.col("_w") * F.col("_share._left")) / (F.col("_share._open") * budget[1])
    target = F.when(full | F.col("_share").isNull(), F.col("_cap").cast("double")).otherwise(shared)
    return t.select("source", "source_size", target.alias("target"))


def mix_plan(sizes: DataFrame, weights: Sequence[int], budget: tuple[int, int], at_most: int) -> DataFrame:
    """(_s, source_size, target, _full, _below): how often each source is taken whole, and up to which place once more.

    ``sizes`` is (source, size, _u), materialised. The mix takes ``budget[0] / budget[1]`` times all words. A source with a target of q sizes and a rest takes all its
    documents q times and, for the rest, once more those whose place is up to a threshold: the prefix of the order
    whose sum comes nearest to it (the shorter if two are as near). Documents of one place (repeated doc_ids) go
    together. Size counts words, 0 for a null text; a null source is a source of its own, the last one.

    Histograms of 2^12 buckets a level find the threshold: each level sums sizes by source and bucket, keeps the
    bucket in which the rest ends, and only that bucket's rows reach the next. Nothing is sorted.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut(
        source_targets(sizes, weights, budget, at_most)
        .withColumn("_full", F.floor(share).cast("int"))
        .withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("_full") * F.col("source_size")).otherwise(0.0))
    )
    edge = targets.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_at"), F.col("_rest"))
    for shift in range(BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("_u", shift + LEVEL_BITS) == F.col("_at") if shift + LEVEL_BITS < BITS else F.lit(True)
        run = Window.partitionBy("_s").orderBy("_bucket")
        edge = cut(
            sizes.join(small(edge), F.col("source").eqNullSafe(F.col("_s")) & inside)
            .groupBy("_s", "_rest", F.shiftright("_u", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
            .withColumn("_before", F.sum("_sum").over(run) - F.col("_sum"))
            .where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest")))
            .select("_s", F.col("_bucket").alias("_at"), (F.col("_rest") - F.col("_before")).alias("_rest"),
                    F.col("_sum").alias("_last"))
        )
    nearer = F.col("_last") - F.col("_rest") < F.col("_rest")
    limit = edge.select("_s", F.when(nearer, F.col("_at") + 1).otherwise(F.col("_at")).alias("_below"))
    return cut(
        targets.join(small(limit), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(F.col("source").alias("_s"), "source_size", "target", "_full",
                F.coalesce("_below", F.lit(1 << BITS)).alias("_below"))
    )


def _with_copies(rows: DataFrame, plan: DataFrame, at_most: int) -> DataFrame:
    more = (F.col("_full") < at_most) & (F.col("target") > F.col("_full") * F.col("source_size")) & (F.col("_u") < F.col("_below"))
    return rows.join(small(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.col("_full") + more.cast("int"))


def _sizes(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("_u")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), at_most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of ``docs``, by ``mix_plan``.

    Repeated rows each get the copies of their doc_id and source; a null doc_id is one id like any other; a null or white
    text of any kind has size 0, a very long one counts whole. Other columns, whatever their names (``size``, ``copies``),
    play no part; an empty table gives an empty table.
    """
    sizes = _sizes(docs)
    return _with_copies(sizes, mix_plan(sizes, weights, budget, at_most), at_most).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), at_most: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they are, whatever their names.

    Nulls, repeated rows, very long texts and an empty table count as in ``mix``.
    """
    plan = mix_plan(_sizes(docs), weights, budget, at_most)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", place(F.col("doc_id")).alias("_u"))
    taken = _with_copies(rows, plan, at_most).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS u FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, 2 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS everything FROM total),
filled AS (
  SELECT *, everything * 3 - 2 * CAST(coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unspent,
         CAST(sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighed WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
shared AS (
  SELECT *, cap * open * 2 <= w * unspent AS is_full FROM filled),
first_open AS (SELECT unspent AS u0, open AS o0 FROM shared WHERE NOT is_full ORDER BY cap / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full OR o0 IS NULL THEN CAST(cap AS DOUBLE) ELSE (w * u0)::DOUBLE / (o0 * 2)::DOUBLE END AS target
  FROM shared LEFT JOIN first_open ON true),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n_full FROM targets),
places AS (SELECT source, u, sum(size) AS s FROM sizes GROUP BY source, u),
running AS (
  SELECT p.source, u, s, sum(s) OVER (PARTITION BY p.source ORDER BY u) - s AS s_before,
         target - n_full * source_size AS rest
  FROM places p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source),
taken_places AS (
  SELECT source, u FROM running
  WHERE rest > 0 AND (s_before + s <= rest OR (s_before <= rest AND s_before + s - rest < rest - s_before)))
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (r.n_full + CASE WHEN t.u IS NOT NULL AND r.n_full < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN taken_places t ON t.source IS NOT DISTINCT FROM d.source AND t.u = d.u
"""
