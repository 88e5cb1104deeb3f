"""Benchmark decontamination: windows of test words found in training texts, and spans or documents removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.line_dedup import LOWER, UPPER
from quern.llm.shared import cut, small, whole

#: Words of a window.
WINDOW = 10
#: Windows of the benchmark that are broadcast at most, and their bytes; and hashes of their blocks (eight bytes each).
SMALL_WINDOWS, SMALL_BYTES, SMALL_BLOCKS = 200_000, 32 << 20, 2_000_000
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What becomes one space: all between words but single spaces.
APART = BETWEEN + r"{2,}|[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A word of a spelled text with the space behind it.
ONE = "(?:[^ ]++ )"
#: No match is tried inside a word, or a long last one would be read once a letter.
START = "(?<![^ ])"


def spelled(text: Column) -> Column:
    """The words of a text, A-Z lowered, with one space behind each; a single space if there are none."""
    text = whole(text)
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.concat(F.btrim(F.regexp_replace(lowered, APART, " "), F.lit(" ")), F.lit(" "))


def count_words(words: Column) -> Column:
    """The words of a spelled text: its spaces, but for one before an empty text's."""
    return F.greatest(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))), F.lit(0)) - (words == " ").cast("int")


def grams(words: Column, n: int) -> Column:
    """All stretches of ``n`` words of a spelled text, in order."""
    return F.regexp_extract_all(words, F.lit(f"{START}(?=({ONE}{{{n}}}))[^ ]++ "), F.lit(1))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, window, item_id) once each: every ``window`` consecutive words of an item, or all of one that has fewer."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), spelled(F.col("text")).alias("_words")).where("_words <> ' '")
    many = items.select("item_id", F.explode(grams(F.col("_words"), window)).alias("window")).withColumn("n", F.lit(window))
    few = items.withColumn("n", count_words(F.col("_words"))).where(F.col("n") < window).select("item_id", F.col("_words").alias("window"), "n")
    return many.unionByName(few).select("n", "window", "item_id").distinct()


def _hits(texts: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(_k1, _k2, at, n, window) of the places at which windows of ``n`` words stand in the texts of rows (_k1, _k2, _words).

    Texts are read in steps of ``s`` words, each with the ``n - 1`` words behind them, so that each window lies in the stretch of
    the step that it starts in. All windows that start in a step hold its last word and the ``n - s`` behind it: this block is
    looked up by its hash first, and only where a window of the benchmark holds it the step's windows are made and compared.
    """
    block = (n + 1) // 2
    s = n - block + 1
    steps = F.regexp_extract_all("_words", F.lit(f"{START}(?=({ONE}{{1,{s + n - 1}}})){ONE}{{1,{s}}}"), F.lit(1))
    shared = F.regexp_extract("_stretch", f"^{ONE}{{{s - 1}}}({ONE}{{{block}}})", 1)
    known = windows.select(F.explode(grams(F.col("window"), block)).alias("_b")).select(F.xxhash64("_b").alias("_block")).distinct()
    near = (
        texts.select("_k1", "_k2", F.posexplode(steps).alias("_step", "_stretch"))
        .withColumn("_shared", shared).where("_shared <> ''").withColumn("_block", F.xxhash64("_shared"))
        .join(small(known, SMALL_BLOCKS), "_block", "left_semi")
    )
    count, size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    to_find = F.broadcast(windows) if count <= SMALL_WINDOWS and (size or 0) <= SMALL_BYTES else windows
    made = near.select("_k1", "_k2", "_step", F.posexplode(grams(F.col("_stretch"), n)).alias("_pos", "window"))
    return made.join(to_find, "window").select("_k1", "_k2", (F.col("_step") * s + F.col("_pos")).alias("at"), F.lit(n).alias("n"), F.xxhash64("window").alias("_w1"), F.xxhash64(F.lit(1), "window").alias("_w2"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns of ``docs``, then ``n_words``, ``hit_words`` (sorted numbers of the words in any hit) and ``items`` (sorted ids of the items hit).

    Words are what ASCII characters other than letters and digits separate; A-Z are lowered. An item's windows are its
    ``window`` consecutive words, or all its words if it has fewer. Hits are windows of equal words, not of equal hashes
    alone. A null or empty text, of a document or an item, has no words; a null item_id hits but isn't listed. Repeated rows
    of equal doc_id and text have equal results; equal items are all listed. A doc_id may be null. Empty tables give
    documents without hits, or no rows. Input columns named n_words, hit_words or items are replaced, others are kept. A
    very long text takes time in proportion to its words.

    Texts are scanned once for hits, which are written as narrow rows, and joined with them by 128 bits of doc_id and
    text. The benchmark's windows are broadcast if they are small enough, else joined by a shuffle.
    """
    names = [c for c in docs.columns if c not in ("n_words", "hit_words", "items")]
    text = whole(F.col("text"))
    key = [F.xxhash64("doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("_k2")]
    owned = cut(windows_of(benchmark, window))
    lengths = sorted(r.n for r in owned.select("n").distinct().collect())  # at most ``window`` numbers
    texts = docs.select(*key, spelled(F.col("text")).alias("_words"))
    empty = docs.sparkSession.createDataFrame([], "_k1 long, _k2 long, at int, n int, _w1 long, _w2 long")
    hits = empty
    for n in lengths:
        hits = hits.unionByName(_hits(texts, owned.where(F.col("n") == n).select("window").distinct(), n))
    hits = cut(hits)
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    places = hits.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("at", "n")).alias("_at")).select("_k1", "_k2", F.sort_array(covered).alias("hit_words"))
    owners = owned.where("item_id IS NOT NULL").select(F.xxhash64("window").alias("_w1"), F.xxhash64(F.lit(1), "window").alias("_w2"), "item_id")
    listed = (
        hits.select("_k1", "_k2", "_w1", "_w2").distinct().join(small(owners), ["_w1", "_w2"])
        .groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    held = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]  # no name of the table clashes with those used here
    counted = docs.select(*held, *key, spelled(F.col("text")).alias("_words")).withColumn("n_words", count_words(F.col("_words")).cast("long")).drop("_words")
    joined = counted.join(places.join(listed, ["_k1", "_k2"], "left"), ["_k1", "_k2"], "left")
    return joined.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "n_words",
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` with the words that :func:`contamination` finds taken out of ``text``, each with what stands between it and the word before.

    Texts without hits stay as they are, null ones too.
    """
    found = contamination(docs, benchmark, window)
    pieces = F.when(F.size("hit_words") > 0, F.regexp_extract_all("text", F.lit(f"{BETWEEN}*+{INSIDE}++"), F.lit(0)))
    cut_up = found.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col("text").alias("_text"), "hit_words", pieces.alias("_pieces"))
    cut_up = cut_up.withColumn("_stay", F.when(F.col("_pieces").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_pieces") - 1), "hit_words")))
    rest = F.substring(F.col("_text"), F.length(F.array_join("_pieces", "")) + 1, F.length("_text"))
    left = F.concat(F.array_join(F.transform("_stay", lambda k: F.get("_pieces", k)), ""), rest)
    return cut_up.select(*[F.when(F.col("_stay").isNull(), F.col("_text")).otherwise(left).alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which :func:`contamination` finds no word."""
    return contamination(docs, benchmark, window).where(F.size("hit_words") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
starts AS (
  SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s
  FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM starts),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (
  SELECT doc_id, words, l.n, unnest(range(1, len(words) - l.n + 2)) AS s
  FROM texts, (SELECT DISTINCT n FROM windows) l WHERE len(words) >= l.n),
hits AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM (SELECT doc_id, n, s, array_to_string(words[s:s + n - 1], ' ') AS w FROM places) p
  JOIN windows w ON p.n = w.n AND p.w = w.w),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN listed l ON t.doc_id = l.doc_id
"""
