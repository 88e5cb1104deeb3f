"""Token-ID output: raw id payloads in shards, each with a minimal perfect hash index of its documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import new_path
from quern.llm.tokens import Encoder, WordEncoder, public
from quern.llm.words import mixed

#: A shard file: this, five numbers (documents, buckets, ids, bytes of an id, the seed of its hashes), the bucket displacements, then by slot the
#: fingerprints, offsets and lengths, then the keys in order (doc_ids, and which are null), then the ids as they are. All
#: numbers are little-endian.
MAGIC = b"QUERNTK3"
#: A shard is closed at this many ids or documents.
SHARD_IDS, SHARD_DOCS = 8_000_000, 65_536
#: Seeds that a bucket tries before the build fails; a bucket of distinct keys needs a few thousand at most.
MOST_SEEDS = 1 << 22
#: Seeds of a shard's hashes that are tried.
SEEDS = 16
#: Tasks that read an index back at most (about); each reads whole shards.
READ_TASKS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def key_hash(ids: np.ndarray, repeats: np.ndarray, absent: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of a key: the doc_id, whether it is null, and how many rows of that doc_id came before; other ones for another seed."""
    first = mixed(ids.astype(np.int64).view(np.uint64) * _ODD + absent.astype(np.uint64) + np.uint64(2 * seed))
    return mixed(first + repeats.astype(np.uint64) * _ODD + mixed(np.array([seed], np.uint64)))


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h + (seed.astype(np.uint64) + np.uint64(1)) * _ODD) % np.uint64(n)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements by bucket, slot of each key): distinct hashes get distinct slots 0..n-1.

    Buckets of about four keys, the largest first, try seeds until all their slots are free; a bucket of one key
    stores a free slot itself, as -1 - slot.
    """
    n = len(h)
    if len(np.unique(h)) < n:
        raise ValueError("two keys of one hash in a shard")
    n_buckets = max(1, n // 4)
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    sizes = np.diff(bounds)
    shift, slots, free = np.zeros(n_buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[bounds[b] : bounds[b + 1]]
        for seed in range(0, MOST_SEEDS, 64):
            tries = _slot(h[own][:, None], np.arange(seed, seed + 64)[None, :], n)
            spread = np.sort(tries, axis=0)
            good = np.flatnonzero(free[tries].all(axis=0) & (spread[1:] != spread[:-1]).all(axis=0))
            if len(good):
                shift[b], slots[own] = seed + good[0], tries[:, good[0]]
                free[slots[own]] = False
                break
        else:
            raise ValueError("no seed spreads a bucket")
    left = np.flatnonzero(free)
    for b, at in zip(np.flatnonzero(sizes == 1), left, strict=True):
        shift[b], slots[order[bounds[b]]] = -1 - at, at
    return shift, slots


class Shard:
    """An open shard. ``locate`` gives each key's offset and length in constant time; ``ids`` reads a span."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        head = self.file.read(48)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.n, self.n_buckets, self.n_ids, self.width, self.seed = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        read = lambda kind, n: np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)
        self.shift, self.print = read("<i4", self.n_buckets), read("<u4", self.n)
        self.offset, self.length = read("<u8", self.n), read("<u4", self.n)
        self.doc_ids, self.absent = read("<i8", self.n), read("u1", self.n).astype(bool)
        self.payload = self.file.tell()

    def find(self, ids: np.ndarray, repeats: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`locate` of keys, hashed with the shard's own seed."""
        return self.locate(key_hash(ids, repeats, absent, self.seed))

    def locate(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, offset, length); a key that wasn't indexed fails the fingerprint but for one in 2^32."""
        if not self.n:
            none = np.zeros(len(h), np.int64)
            return none.astype(bool), none, none
        shift = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift.astype(np.int64), _slot(h, np.maximum(shift, 0), self.n))
        return self.print[slot] == (h >> np.uint64(32)), self.offset[slot].astype(np.int64), self.length[slot].astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        self.file.seek(self.payload + self.width * start)
        return np.frombuffer(self.file.read(self.width * n), f"<u{self.width}").astype("<u4")


def repeats_of(ids: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """How many equal keys stand just before each key."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (absent[1:] != absent[:-1])])
    return np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]


def _write(folder: str, ids: np.ndarray, absent: np.ndarray, length: np.ndarray, payload: list[np.ndarray]) -> str:
    repeats = repeats_of(ids, absent)
    for seed in range(SEEDS):  # two keys of one hash are as rare as a pair in 2^64; another seed parts them
        try:
            h = key_hash(ids, repeats, absent, seed)
            shift, slots = build_index(h)
            break
        except ValueError:
            if seed == SEEDS - 1:
                raise
    offset = np.cumsum(length) - length
    put = lambda x, kind: (out := np.zeros(len(h), kind), out.__setitem__(slots, x))[0]
    width = 2 if max((int(x.max()) for x in payload if len(x)), default=0) < 1 << 16 else 4
    path = f"{folder}/{uuid.uuid4().hex}.tokens"
    system, name = fs.FileSystem.from_uri(path)
    with system.open_output_stream(name) as out:
        out.write(MAGIC + np.array([len(h), len(shift), length.sum(), width, seed], "<u8").tobytes() + shift.astype("<i4").tobytes())
        for x, kind in ((h >> np.uint64(32), "<u4"), (offset, "<u8"), (length, "<u4")):
            out.write(put(x, kind).tobytes())
        out.write(ids.astype("<i8").tobytes() + absent.astype("u1").tobytes())
        for x in payload:
            out.write(x.astype(f"<u{width}").tobytes())
    return path


MANIFEST = "part int, shard int, path string, n_docs long, n_ids long"


def write_index(
    docs: DataFrame, folder: str, encoder: Encoder, end_id: int | None = 1, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """Write the ids of all ``docs`` (doc_id, text) in ascending doc_id order and return the manifest.

    A range of doc_ids goes to a task, which writes shards as it goes; rows of one doc_id, however many, may go to
    several. The manifest, one row a shard in (part, shard) order, names the files that count; those of a lost attempt
    are in no manifest. A null text is empty; a null doc_id comes first; rows of one doc_id follow a hash of their text
    and are told apart by their number in the shard. A very long text is in one shard, which it may fill beyond its
    bound. Other columns play no part; an empty table writes no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ids, absent, length = (np.concatenate([x[k] for x in held]) for k in range(3))
            path = _write(folder, ids, absent, length, [x[3] for x in held])
            row = ([part], [shard], [path], [len(ids)], [int(length.sum())])
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], ["part", "shard", "path", "n_docs", "n_ids"])

        n_ids = n_docs = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                doc_id = some.column("doc_id")
                ids, absent = pc.fill_null(doc_id, 0).to_numpy().astype(np.int64), doc_id.is_null().to_numpy(zero_copy_only=False)
                payload, bounds = encoder(some.column("text"))
                if end_id is not None:
                    payload = np.insert(payload, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                k = 0
                while k < len(ids):  # up to where the shard is full
                    room = int(np.searchsorted(bounds, bounds[k] + shard_ids - n_ids, "right")) - 1
                    end = min(len(ids), room, k + shard_docs - n_docs)
                    if end <= k and not n_docs:
                        end = k + 1
                    if end > k:
                        held.append((ids[k:end], absent[k:end], np.diff(bounds[k : end + 1]), payload[bounds[k] : bounds[end]]))
                        n_ids, n_docs, k = n_ids + int(bounds[end] - bounds[k]), n_docs + end - k, end
                    if k < len(ids):
                        yield close()
                        shard, n_ids, n_docs, held = shard + 1, 0, 0, []
        if held:
            yield close()

    fs_of, name = fs.FileSystem.from_uri(folder)
    fs_of.create_dir(name, recursive=True)
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), "_tie")
    (
        rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
        .mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    )
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every indexed document, each found by key in its shard.

    Shards are dealt over tasks. ``start`` sums shard sizes, first by part, then in a part, over one narrow row a shard,
    and adds the offset in the shard. A shard that doesn't hold its own keys raises an error.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part_first"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    rows = manifest.withColumn("_inside", inside).join(parts, "part").select("path", (F.col("_part_first") + F.col("_inside")).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                shard = Shard(path)
                ids, absent = shard.doc_ids, shard.absent
                known, offset, length = shard.find(ids, repeats_of(ids, absent), absent)
                if not known.all():
                    raise ValueError(f"{path} is damaged: {int((~known).sum())} of its keys aren't found")
                payload = memoryview(shard.ids(0, shard.n_ids)).cast("B")
                crc = [zlib.crc32(payload[4 * a : 4 * (a + n)]) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=absent), pa.array(offset + first), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = manifest.count()
    tasks = max(1, -(-n // max(1, n // READ_TASKS)))
    return rows.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write_index(docs, folder, WordEncoder(public("word_bpe_49k.json")))
    return read_index(spark, folder)
