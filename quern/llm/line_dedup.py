"""Line dedup: drop lines that many documents share, keeping each in one document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import SPACE, cut, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lowered; other letters keep their case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Columns of ``docs`` with the remaining lines as ``text``, then ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents, told apart by doc_id, loses all
    its lines except in the largest doc_id holding it; repeated rows of that doc_id all keep them. A null text is one
    empty line; a null doc_id is a document of its own that ranks below every other. Input columns named n_lines or
    n_dropped are replaced; other columns, whatever their names, are kept. An empty table gives an empty table. A very
    long text takes time in proportion to its lines.

    Lines are exploded and hashed once: (document, position, 128 bits of the key) is written, counted by distinct
    document, and joined with the frequent keys. Both sides of that join are exchanged for it, so that adaptive
    execution can split a hot line. Each row, known by its doc_id and 128 bits of its text, is reassembled from the
    positions that stay.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = whole(F.col("text"))
    mark = lambda column: (F.xxhash64(column), F.xxhash64(F.lit(1), column))
    row = [x.alias(n) for x, n in zip(mark(text), ("_t1", "_t2"), strict=True)]
    key = line_key(F.col("_line"))
    lines = docs.select(F.col("doc_id").alias("_id"), *row, F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keys = cut(
        lines.where(F.length("_line") >= min_chars).select("_id", "_t1", "_t2", "_pos", key.alias("_key")).where(F.length("_key") >= min_chars)
        .select("_id", "_t1", "_t2", "_pos", *[x.alias(n) for x, n in zip(mark(F.col("_key")), ("_k1", "_k2"), strict=True)])
    )
    frequent = cut(
        keys.select("_k1", "_k2", "_id").distinct().groupBy("_k1", "_k2").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper"))
        .where(F.col("_n") >= min_docs).drop("_n")
    )
    lost = (
        keys.join(frequent, ["_k1", "_k2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_lost"))
    )
    same = F.col("_d.doc_id").eqNullSafe(F.col("_x._id")) & (F.col("_d._r1") == F.col("_x._t1")) & (F.col("_d._r2") == F.col("_x._t2"))
    marked = docs.select(*names, *[x.alias(n) for x, n in zip(mark(text), ("_r1", "_r2"), strict=True)]).alias("_d")
    all_lines = F.split(whole(F.col("_d.text")), "\n", -1)
    joined = marked.join(lost.alias("_x"), same, "left").withColumn("_lines", all_lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    joined = joined.withColumn("_stay", F.when(F.col("_lost").isNotNull(), stay))
    left = F.array_join(F.transform("_stay", lambda k: F.get("_lines", k)), "\n")
    return joined.select(
        *[F.when(F.col("_stay").isNull(), whole(F.col("_d.text"))).otherwise(left).alias(c) if c == "text" else F.col(f"_d.`{c}`") for c in names],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_stay"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, line, pos, freq.k IS NOT NULL AND doc_id <> keeper AS dropped
  FROM keyed LEFT JOIN freq ON keyed.k = freq.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
