"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries, and the commoner form of each word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.line_dedup import LOWER, UPPER
from quern.llm.shared import cut, small, whole

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Code points of a word, its occurrences, and times that its form must be as common.
LEAST_LENGTH, LEAST_COUNT, COMMONER = 5, 3, 2
#: Words of a block that is scanned; a larger one is subdivided. An edit at one place leaves at most 91 words a block.
BLOCK = 256
FOUND = "word string, n_near long, best_n long, best string"


def lowered(run: Column) -> Column:
    """A-Z lowered; other letters keep their case."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def with_lost_letters(docs: DataFrame) -> DataFrame:
    """(word) of each run of letters, lowered; one in 97, by the crc32 of ``<doc_id>:<run>``, has lost a letter.

    A null doc_id stands for the empty string there.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(whole(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("_run")).select("doc_id", lowered(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_run")))
    k = (h % F.length("_run")).cast("int")
    return runs.select(F.when(h % 97 == 0, F.concat(F.substring(F.col("_run"), F.lit(1), k), F.substring(F.col("_run"), k + 2, F.length("_run")))).otherwise(F.col("_run")).alias("word"))


def dictionary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and common enough; one word may be a third of all rows, as counting combines before its shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _blocks(entries: DataFrame) -> DataFrame:
    """Entries with the key of their block: what is intact before ``lo`` and behind ``hi``.

    ``size`` is the shorter word's length and ``more`` tells whether the other has a letter more; the first place at which two
    words differ is in [lo, hi).
    """
    behind = F.greatest(F.col("size") - F.col("hi") + F.col("more"), F.lit(0))
    # a reversed dictionary is sorted from the last letter on
    return entries.withColumn("prefix", F.substring(F.col("word"), F.lit(1), F.col("lo"))).withColumn("suffix", F.reverse(F.substring(F.col("word"), F.length("word") - behind + 1, behind)))


KEY = ["size", "more", "lo", "hi", "prefix", "suffix"]


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry twice: for a difference in the second half of its places, whose first half is intact, and for one in the first."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = lambda lo, hi: F.struct(F.col("word"), F.col("n"), F.col("size"), F.col("more"), lo.alias("lo"), hi.alias("hi"))
    return _blocks(entries.select(F.inline(F.array(half(middle, F.col("hi")), half(F.col("lo"), middle)))).where("lo < hi"))


def first_difference(a: str, b: str, lo: int, hi: int) -> int:
    """The first place in [lo, hi) at which two words differ, if they are alike before ``lo``; else ``hi``."""
    while lo < hi:
        middle = (lo + hi) // 2
        if a[lo : middle + 1] == b[lo : middle + 1]:
            lo = middle + 1
        else:
            hi = middle
    return lo


def near_pairs(block: list[tuple[str, int]], size: int, more: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of a block's words that differ by one edit whose first difference is in [lo, hi).

    A block of fewer words than places compares its pairs; a larger one, words without one letter.
    """
    short = [k for k, (word, _) in enumerate(block) if len(word) == size]
    long = [k for k, (word, _) in enumerate(block) if len(word) == size + 1] if more else []
    if len(block) <= hi - lo:
        for i, j in ((i, j) for i in short for j in long) if more else combinations(short, 2):
            a, b = block[i][0], block[j][0]
            p = first_difference(a, b, lo, hi)
            if p < hi and a[p + 1 - more :] == b[p + 1 :]:
                yield i, j
    elif more:
        at = {block[i][0]: i for i in short}
        for j in long:
            word = block[j][0]
            for p in range(lo, hi):
                if p == size or word[p] != word[p + 1]:  # else the difference comes later
                    i = at.get(word[:p] + word[p + 1 :])
                    if i is not None:
                        yield i, j
    else:
        for p in range(lo, hi):
            alike = defaultdict(list)
            for i in short:
                word = block[i][0]
                alike[word[:p] + word[p + 1 :]].append(i)
            for group in alike.values():
                yield from combinations(group, 2)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, and each word near another of it: how many, and the commonest of these. Blocks come sorted, one at a time."""
    key, block = None, []
    out: list[list] = [[], [], [], []]

    def close() -> None:
        if len(block) < 2:
            return
        counts, best = defaultdict(int), {}
        for pair in near_pairs(block, *key[:4]):
            for own, other in (pair, pair[::-1]):
                counts[own] += 1
                word, n = block[other]
                best[own] = min(best.get(own, (0, "")), (-n, word))
        for own, n in counts.items():
            for column, value in zip(out, (block[own][0], n, -best[own][0], best[own][1]), strict=True):
                column.append(value)

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["word", "n_near", "best_n", "best"])
        for column in out:
            column.clear()
        return made

    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in [*KEY, "word", "n"]]
        for *now, word, n in zip(*columns, strict=True):
            if now != key:
                close()
                key, block = now, []
                if len(out[0]) > 50_000:
                    yield batch()
            block.append((word, n))
    close()
    yield batch()


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the distinct ``words`` (word, n) that are one edit from another: how many, and the commonest (the smallest of equals).

    One edit leaves a half intact: where two words first differ in the second half they share the first, and so stand in one
    block of the sorted dictionary; else they share what is behind, and stand in one of the dictionary of reversed words. A
    block of more than ``most`` words is subdivided in the same way, by halves of the places that are left, until all are
    small; where one place is left at most 91 words are, one a letter. A pair has one first difference, so it meets in
    just one block. Blocks are ranged over the cluster in sorted order and scanned, each a few hundred words in memory.
    """
    length = F.length("word")
    kinds = F.array(*[F.struct(size.alias("size"), F.lit(more).alias("more"), F.lit(0).alias("lo"), hi.alias("hi")) for size, more, hi in ((length, 0, length), (length, 1, length + 1), (length - 1, 1, length))])
    level = cut(_halves(words.select("word", "n", F.inline(kinds))))
    found = None
    while True:
        hash_ = [F.xxhash64(*KEY).alias("_b1"), F.xxhash64(F.lit(1), *KEY).alias("_b2")]
        large = cut(level.where(F.col("hi") - F.col("lo") > 1).groupBy(*hash_).count().where(F.col("count") > most).select("_b1", "_b2"))
        more = not large.isEmpty()
        keyed = level.select("*", *hash_)
        large = small(large) if more else large
        few = keyed.join(large, ["_b1", "_b2"], "left_anti") if more else level
        scanned = few.select(*KEY, "word", "n").repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(_scan, FOUND)
        found = scanned if found is None else found.unionByName(scanned)
        if not more:
            break
        level = cut(_halves(keyed.join(large, ["_b1", "_b2"], "left_semi").select("word", "n", "size", "more", "lo", "hi")))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return near.select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which hold no circle: the end of each word's chain.

    Each round doubles the steps that a chain is followed by, so a chain of d steps takes log2(d) rounds. Only words whose
    chain goes on are joined again.
    """
    open_, done = cut(forms.select("word", F.col("form").alias("root"))), None
    jumps = open_
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(open_.join(ahead, "root", "left"))
        ended = step.where("_next IS NULL").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("_next IS NOT NULL").select("word", F.col("_next").alias("root"))
        if open_.isEmpty():
            return done
        jumps = open_.unionByName(done)


def spelling_variants(words: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n
    (the smallest of equals) if that is at least ``commoner`` times its own n, else null; its root is where the forms
    lead. An empty table gives an empty one. Words may be very long: a block compares its pairs where it has fewer words
    than places.
    """
    words = cut(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= commoner * F.col("n")
    judged = cut(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    led = judged.join(roots(judged.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(dictionary(with_lost_letters(docs)))
