"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut, whole
from quern.llm.words import hashes, mixed, slices, spans, windows
from quern.operators.components import components

#: Words of a shingle, and the least Jaccard likeness of a link.
SHINGLE, LEAST = 5, 0.8
#: Tries of the forest and the length of their full paths.
TREES, DEPTH = 20, 8
#: Matched prefixes are shortened until a lone pair of the least likeness is found with this chance.
RECALL = 0.9999
#: Signatures alike in less than this don't link: 0.8 less five standard deviations of 160 values, which one link of
#: likeness 0.8 in three million falls below.
ALIKE = 0.64
#: Entries of tries, and bytes of texts, that meet in one task (about).
TASK_ENTRIES, TASK_BYTES = 100_000, 16 << 20
#: Documents of one bucket of a trie, and of one family, that meet in one task; more meet in pairs of blocks.
BUCKET, BLOCK = 4096, 1024
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of every ``n`` consecutive words; a shorter row is one shingle of its words, no words none."""
    starts, ends, first = spans(data, at)
    h, counts = hashes(data, starts, ends), np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    full = windows(h, n)
    full = full[row[: len(full)] == row[n - 1 :]] if len(full) else full
    sizes = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.concatenate([windows(h[first[k] : first[k + 1]], counts[k]) ^ np.uint64(counts[k]) for k in short.tolist()])
        full = np.insert(full, (np.cumsum(sizes) - sizes)[short], own)
        sizes[short] = 1
    return full, np.concatenate([[0], np.cumsum(sizes)])


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEPTH) bytes: one of each smallest hash under as many orders; rows without shingles hold zeros."""
    out = np.zeros((TREES * DEPTH, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    i = 0
    while i < len(some):  # parts that stay in a processor's cache
        j = max(i + 1, int(np.searchsorted(bounds[some], bounds[some[i]] + 32_768, "right")) - 1)
        part, firsts = h[bounds[some[i]] : bounds[some[j - 1] + 1]], bounds[some[i:j]] - bounds[some[i]]
        for k in range(TREES * DEPTH):
            out[k, some[i:j]] = np.minimum.reduceat((part ^ _FLIP[k]) * _ODD[k], firsts)
        i = j
    return (mixed(out) >> np.uint64(56)).astype(np.uint8).T


def paths(signature: np.ndarray) -> np.ndarray:
    """(rows, TREES): each row's path in each trie, a step a byte, the first step highest, so that numbers sort as tries do."""
    steps = np.ascontiguousarray(signature).reshape(len(signature), TREES, DEPTH)
    return steps.view(">u8")[:, :, 0].astype(np.uint64)


def prefixes(path: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` steps of paths."""
    return path >> np.uint64(8 * (DEPTH - length))


def recall_at(length: int, likeness: np.ndarray | float) -> np.ndarray | float:
    """The chance that documents so alike share a prefix of this length in one trie at least."""
    return 1 - (1 - likeness**length) ** TREES


def prefix_length(target: float = RECALL, least: float = LEAST) -> int:
    """The longest prefix whose recall at the least likeness reaches the target."""
    return next((length for length in range(DEPTH, 1, -1) if recall_at(length, least) >= target), 1)


def _families(groups: np.ndarray, ids: np.ndarray, signature: np.ndarray) -> tuple[list, list, list]:
    """(a, b, likeness) of links that span what is alike in each run of ``groups`` (sorted): fewer than its rows.

    A row takes in all rows alike that none has taken in before, then each of those does, until none is left.
    """
    a, b, like = [], [], []
    edges = np.flatnonzero(np.concatenate([[True], np.diff(groups) != 0, [True]])) if len(groups) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    twos = edges[:-1][sizes == 2]
    share = (signature[twos] == signature[twos + 1]).mean(axis=1)
    near = share >= ALIKE
    a.append(ids[twos[near]])
    b.append(ids[twos[near] + 1])
    like.append(share[near])
    for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        left = np.arange(start, start + size)
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                one = queue.pop()
                share = (signature[left] == signature[one]).mean(axis=1)
                near = share >= ALIKE
                a.append(np.full(int(near.sum()), ids[one]))
                b.append(ids[left[near]])
                like.append(share[near])
                queue += left[near].tolist()
                left = left[~near]
    return a, b, like


def in_blocks(rows: DataFrame, key: str, most: int, by: str) -> DataFrame:
    """``rows`` of groups of two or more, with ``one`` and ``other``: the two blocks that meet, the same for a small group.

    A group of more than ``most`` rows is dealt into blocks by the hash of ``by``; a row is there for each block it meets.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > 1)
    dealt = (
        rows.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_size") / most).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
        .withColumn("_mate", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    return dealt.withColumn("one", F.least("own", "_mate")).withColumn("other", F.greatest("own", "_mate")).drop("_size", "_blocks", "_mate")


def _task(tasks: int, *keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int")


def trie_links(run: np.ndarray, path: np.ndarray, ids: np.ndarray, signature: np.ndarray, length: int) -> tuple[list, list, list]:
    """(a, b, likeness) of links that span what is alike in each subtrie below a prefix of ``length`` steps.

    Rows come sorted by ``run`` (a subtrie) and path. Matches of whole paths go first; then each entry's prefix is shortened
    step by step while its part of the trie still holds entries that nothing links yet.
    """
    label = np.arange(len(ids))  # the first row that a row is linked with, within its run
    place: dict[int, int] = {}
    found: tuple[list, list, list] = ([], [], [])

    def root(p: int) -> int:
        while place.get(p, p) != p:
            place[p] = p = place.get(place[p], place[p])
        return p

    for depth in range(DEPTH, length - 1, -1):
        prefix = prefixes(path, depth)
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (prefix[1:] != prefix[:-1])]) if len(ids) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        low, high = (np.full(part[-1] + 1 if len(part) else 0, x) for x in (len(ids), -1))
        np.minimum.at(low, part, label)
        np.maximum.at(high, part, label)
        open_ = np.flatnonzero((low < high)[part])
        if not len(open_):
            continue
        rows = np.arange(len(ids))[open_]
        a, b, like = _families(part[open_], rows, signature[open_])
        for p, q, share in zip(*(np.concatenate(x).tolist() for x in (a, b, like)), strict=True):
            one, other = root(p), root(q)
            if one != other:
                place[max(one, other)] = min(one, other)
                found[0].append(ids[p])
                found[1].append(ids[q])
                found[2].append(share)
        for p in place:
            label[p] = root(p)
    return found


def candidates(forest: DataFrame, length: int) -> DataFrame:
    """(a, b, likeness): links between documents that share a prefix of this length, spanning each subtrie's families.

    Subtries below a prefix meet in tasks by their hash, sorted; most hold one document and go before signatures are
    joined. There are as many tasks as entries ask for.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = paths(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            trie = np.broadcast_to(mixed(np.arange(1, TREES + 1, dtype=np.uint64)), path.shape)
            key = mixed(trie + prefixes(path, length) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("id").to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)), pa.array(key.reshape(-1))],
                ["id", "trie", "key"],
            )

    def link(group: pa.Table) -> pa.Table:
        key, one, other, ids, trie = (group[c].to_numpy() for c in ("key", "one", "other", "id", "trie"))
        signature = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(ids), -1)
        path = paths(signature)[np.arange(len(ids)), trie]
        order = np.lexsort((ids, path, other, one, key))
        run = np.concatenate([[False], np.any([np.diff(x[order]) != 0 for x in (key, one, other)], axis=0)])
        parts = trie_links(np.cumsum(run), path[order], ids[order], signature[order], length)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([np.array(part, kind) for part, kind in zip(parts, kinds, strict=True)], ["a", "b", "likeness"])

    met = cut(in_blocks(forest.select("id", "signature").mapInArrow(leaves, "id long, trie int, key long"), "key", BUCKET, "id").drop("own"))
    tasks = max(64, met.count() // TASK_ENTRIES)
    found = (
        met.join(forest, "id").select(_task(tasks, "key", "one", "other").alias("_task"), "key", "one", "other", "id", "trie", "signature")
        .groupBy("_task").applyInArrow(link, "a long, b long, likeness double")
    )
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("likeness").alias("likeness"))


def shared_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """(first, all) numbers of shared members between the first sets and all of them, by products of 0/1 blocks."""
    values, member = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.bincount(member, minlength=len(values)) > 1
    column, keep = np.cumsum(common) - 1, common[member]
    row, member = row[keep], column[member[keep]]
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    exact = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64  # whole numbers that the type holds
    out = np.zeros((first, len(sets)), exact)
    step = 2048
    for start in range(0, int(common.sum()), step):
        i, j = np.searchsorted(member, [start, start + step])
        ones = np.zeros((len(sets), min(step, int(common.sum()) - start)), exact)
        ones[row[i:j], member[i:j] - start] = 1
        out += ones[:first] @ ones.T
    return out.astype(np.int64)


def verify(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of the rows of one meeting: the smallest id linked there, and the copies of what each is linked with.

    The first rows meet all others and, if they are all rows, each other.
    """
    sizes = np.array([len(x) for x in sets])
    shared = shared_counts(sets, first)
    linked = shared >= least * (sizes[:first, None] + sizes[None, :] - shared) - 1e-9
    linked[np.arange(first), np.arange(first)] = False
    if first < len(ids):
        linked[:, :first] = False
    links = np.zeros(len(ids), np.int64)
    links[:first] = linked @ copies
    if first < len(ids):
        links[first:] = linked[:, first:].T @ copies[:first]
    every = np.zeros((len(ids), len(ids)), bool)
    every[:first] = linked
    every |= every.T
    left, root = np.ones(len(ids), bool), ids.copy()
    for k in np.argsort(ids, kind="stable").tolist():
        queue = [k] if left[k] else []
        left[k] = False
        while queue:
            m = queue.pop()
            root[m] = ids[k]
            more = np.flatnonzero(every[m] & left)
            left[more] = False
            queue += more.tolist()
    return root, links


def jaccard_classes(docs: DataFrame, least: float = LEAST, n: int = SHINGLE, target: float = RECALL) -> DataFrame:
    """(doc_id, text_id, class_id, n_links) for each row of ``docs``.

    Rows whose sets of ``n``-word shingles have a Jaccard likeness of at least ``least`` are linked. ``text_id`` is the
    smallest doc_id of the same text, ``class_id`` the smallest doc_id linked over any number of steps, ``n_links``
    how many other rows the row is linked with (each copy counts). A text of fewer words is one shingle of them all; a
    null, empty or white text has no shingle, is linked with nothing and is its own class. Rows of one doc_id (null is
    one too, below every other; the smallest long counts as null) share a class. Other columns play no part; an empty table gives an empty table.

    Equal texts become one first. The forest then matches the longest prefixes that find a lone pair just alike enough
    with a chance of ``target``, whatever other links there are. Links between signatures join documents to families;
    inside families all pairs are verified on whole shingle sets, in blocks, where only counts and spanning links leave
    a task.
    """
    digest = F.unhex(F.md5(whole(F.col("text"))))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), whole(F.col("text")).alias("text"), digest.alias("digest"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column("text")):
                h, bounds = shingles(data, at, n)
                some = np.flatnonzero(np.diff(bounds) > 0)
                signed = [x.tobytes() for x in signatures(h, bounds)[some]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(i + some)), batch.column("digest").take(pa.array(i + some)), pa.array(signed, pa.binary()), pa.array(np.diff(at)[some])],
                    ["id", "digest", "signature", "bytes"],
                )

    signed = rows.select("id", "digest", "text").mapInArrow(sign, "id long, digest binary, signature binary, bytes long")
    texts = cut(
        signed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("signature").alias("signature"), F.max("bytes").alias("bytes"))
    )
    forest = texts.select("id", "signature")
    families = components(cut(candidates(forest, prefix_length(target, least)))).withColumnRenamed("root", "family")
    members = cut(in_blocks(texts.select("id", "digest", "copies", "bytes").join(families, "id"), "family", BLOCK, "digest"))
    tasks = max(64, (members.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // TASK_BYTES)
    shape = "digest binary, id long, root long, links long"

    def meet(group: pa.Table) -> pa.Table:
        family, one, other, own, ids, copies = (group[c].to_numpy() for c in ("family", "one", "other", "own", "id", "copies"))
        digests, column = group["digest"].to_pylist(), group["text"].combine_chunks()
        sets: list[np.ndarray] = []
        for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
            for _, _, data, at in slices(chunk):
                h, bounds = shingles(data, at, n)
                sets += [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        meetings: dict[tuple, dict[bytes, int]] = {}
        for k, key in enumerate(zip(family.tolist(), one.tolist(), other.tolist(), strict=True)):
            meetings.setdefault(key, {}).setdefault(digests[k], k)  # repeated rows are one text
        out: list[list] = [[], [], [], []]
        for (_, a, b), held in meetings.items():
            at = np.array(list(held.values()))
            at = at[np.argsort(own[at] != a, kind="stable")]
            first = len(at) if a == b else int((own[at] == a).sum())
            if not first:
                continue
            root, linked = verify(ids[at], copies[at], [sets[k] for k in at.tolist()], first, least)
            for column_, x in zip(out, ([digests[k] for k in at.tolist()], ids[at].tolist(), root.tolist(), linked.tolist()), strict=True):
                column_ += x
        return pa.table([pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["digest", "id", "root", "links"])

    # one plan at every size: members grow with the input, so they are never broadcast
    met = members.hint("merge").join(rows.select("id", "digest", "text"), ["id", "digest"]).withColumn("_task", _task(tasks, "family", "one", "other"))
    verified = cut(met.groupBy("_task").applyInArrow(meet, shape))
    classes = components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    by_text = texts.select("digest", F.col("id").alias("text_id"), "copies").join(counted, "digest", "left").join(classes.withColumnRenamed("id", "text_id"), "text_id", "left")
    own = rows.select("doc_id", "id", "digest").join(by_text.select("digest", "text_id", "copies", "links", "root"), "digest", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return own.select(
        "doc_id", real(F.coalesce("text_id", "id")).alias("text_id"), real(F.coalesce("root", "text_id", "id")).alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the smallest doc_id, and of its rows of one text one.

    That one is the first by its other columns, written as text. Columns stay as they are. Rows of a null doc_id count as
    one document, below every other.
    """
    kept = jaccard_classes(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    others = [F.col(c).cast("string").asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", F.md5("text")).orderBy(*others or [F.lit(0)])
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept"))).withColumn("_kept", F.row_number().over(first))
    return one.where(F.col("_kept") == 1).drop("_kept")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS id, count(*) AS copies,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents GROUP BY coalesce(text, '')),
shingle AS (
  SELECT DISTINCT id, array_to_string(words[s:s + 4], ' ') AS k
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS s FROM texts WHERE len(words) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.k = b.k AND a.id <> b.id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT id, id AS other FROM texts UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
linked AS (SELECT a AS id, sum(copies) AS n FROM links JOIN texts ON texts.id = b GROUP BY a)
SELECT d.doc_id, CASE WHEN len(t.words) > 0 THEN t.id ELSE d.doc_id END AS text_id,
       CASE WHEN len(t.words) > 0 THEN c.class_id ELSE d.doc_id END AS class_id,
       CASE WHEN len(t.words) > 0 THEN CAST(t.copies - 1 + coalesce(l.n, 0) AS BIGINT) ELSE 0 END AS n_links
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.t JOIN classes c ON c.id = t.id LEFT JOIN linked l ON l.id = t.id
"""
