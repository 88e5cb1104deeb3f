"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import SPACE, cut, small, whole

#: Words of a shingle; one hash in SCALE is below the threshold; a shorter document keeps its FLOOR smallest.
SHINGLE, SCALE, FLOOR = 5, 16, 64
THRESHOLD = -(1 << 63) + (1 << 64) // SCALE
LARGEST = (1 << 63) - 1


def words(text: Column) -> Column:
    bare = F.btrim(whole(text), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """A hash of every ``n`` consecutive words, or of all words where there are fewer; none of no words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashed)


def retain(hashes: Column) -> Column:
    """The sketch: every hash up to the threshold, and at least the FLOOR smallest, sorted."""
    under = F.array_distinct(F.filter(hashes, lambda h: h <= THRESHOLD))
    return F.when(F.size(under) >= FLOOR, F.sort_array(under)).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, FLOOR))


def with_sketch(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    """``docs`` and the sketch of a text column, an array of longs, in steps so that no array is made twice.

    A null text is empty and has the empty sketch; equal texts have equal sketches; very long texts keep one hash in
    SCALE. A column of that name is replaced.
    """
    return (
        docs.withColumn("_words", words(F.col(text))).withColumn("_hashes", shingle_hashes(F.col("_words")))
        .withColumn(name, retain(F.col("_hashes"))).drop("_words", "_hashes")
    )


def _complete_to(sketch: Column) -> Column:
    """The hash up to which a sketch holds every shingle."""
    return F.when(F.size(sketch) < FLOOR, F.lit(LARGEST)).otherwise(F.greatest(F.lit(THRESHOLD), F.array_max(sketch)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together, from their sketches."""
    bound = F.least(_complete_to(a), _complete_to(b))
    return retain(F.filter(F.array_union(a, b), lambda h: h <= bound))


def containment(a: Column, b: Column) -> Column:
    """The part of the document with fewer shingles that is in the other, from what both sketches hold entirely.

    1 for two documents without words, 0 for one.
    """
    bound = F.least(_complete_to(a), _complete_to(b))
    x, y = (F.filter(s, lambda h: h <= bound) for s in (a, b))
    fewer = F.least(F.size(x), F.size(y))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(fewer == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / fewer)


def spelled(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), ",")


def next_below(ids: DataFrame, id_col: str = "doc_id", block_rows: int = 1_000_000) -> DataFrame:
    """(id, next): the largest smaller id of distinct non-null ``ids``; after the smallest, the largest.

    Ids are ranged into blocks of about ``block_rows`` and written once, so that each id's block stays what it is. In a
    block the next id is the window's; a block's smallest id gets the largest of the block below, from a table of one row
    a block.
    """
    blocks = max(1, -(-ids.count() // block_rows))
    dealt = cut(ids.repartitionByRange(blocks, id_col).withColumn("_block", F.spark_partition_id()))
    tops = dealt.groupBy("_block").agg(F.max(id_col).alias("_top"))
    order = Window.orderBy(F.col("_block").desc())
    below = tops.select(
        F.col("_block").alias("_b"),
        F.coalesce(F.lead("_top").over(order), F.max("_top").over(Window.partitionBy())).alias("_below"),
    )
    inside = F.lead(id_col).over(Window.partitionBy("_block").orderBy(F.col(id_col).desc()))
    return (
        dealt.withColumn("_next", inside).join(small(below), F.col("_block") == F.col("_b"))
        .select(id_col, F.coalesce("_next", "_below").alias("next"))
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text.

    Rows of one doc_id are all returned; where they are a next document, the largest (text, sketch) counts. A null
    doc_id has no next document: its text stays unedited and its next document is empty. Texts are shuffled once, by
    doc_id, for both joins; what a document gives to its neighbour is the prefix it needs and the sketch.
    """
    every = with_sketch(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", whole(F.col("text")).alias("text")))
    docs = every.where(F.col("doc_id").isNotNull())  # the same rows for both joins: one exchange serves them
    sizes = cut(
        spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.floor(F.length(whole(F.col("text"))) / 3)).cast("int").alias("_need"))
    )
    pairs = next_below(sizes.select("doc_id")).join(sizes, "doc_id").select(F.col("doc_id").alias("_to"), "_need", F.col("next").alias("_from"))
    given = (
        docs.join(pairs, F.col("doc_id") == F.col("_from"))
        .select("_to", F.struct(F.expr("left(text, _need)").alias("start"), F.col("sketch")).alias("_given"))
        .groupBy("_to").agg(F.max("_given").alias("_given"))
    )
    n, need = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - need), F.substring(F.col("_given.start"), F.lit(1), need))
    joined = docs.join(given, F.col("doc_id") == F.col("_to")).select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "sketch", F.col("_given.sketch").alias("_next_sketch"),
    )
    alone = every.where(F.col("doc_id").isNull()).select(
        "doc_id", n.cast("long").alias("n_chars"), F.col("text").alias("_edited"), "sketch", F.array().cast("array<bigint>").alias("_next_sketch"),
    )
    both = with_sketch(joined.unionByName(alone), "_edited", "_edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("_edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("_edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("_next_sketch")).alias("near_next"),
    )
