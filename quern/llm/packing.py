"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut
from quern.llm.tokens import ByteEncoder, Encoder, public
from quern.llm.words import mixed

CAPACITY = 2048
#: What is tried in turn until a plan reaches the bound of all tokens: how full a configuration is that is rounded up from the program, one less
#: full being solved again with the rest, and the part of all tokens, in the shortest pieces, that is held back to fill gaps with.
TRIES = ((0.98, 0.003), (0.995, 0.0), (0.999, 0.003), (0.9995, 0.01), (0.98, 0.0))
#: Above 1, so that of two full configurations the one of fewer, longer pieces is dearer and short ones are left to fill with.
POWER = 1.1
#: A configuration: (length, how many of it) pairs, and how many sequences are packed so.
Packed = list[tuple[tuple[tuple[int, int], ...], int]]


def room_values(price: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest multiset of lengths for every room up to ``capacity`` (knapsack by dynamic programming)."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (price[1 : room + 1] + best[room - 1 :: -1]).max())
    return best


def configuration(seed: int, price: np.ndarray, best: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration with a piece of length ``seed``, traced through ``best``, of pieces that ``left`` holds."""
    found, room, allowed = {seed: 1}, capacity - seed, np.where(left > 0, price, -np.inf)
    while room > 0:
        if found.get(seed, 0) >= left[seed]:
            allowed[seed] = -np.inf
        worth = allowed[1 : room + 1] + best[room - 1 :: -1]
        seed = int(np.argmax(worth)) + 1
        if worth[seed - 1] == -np.inf:
            break
        found[seed] = found.get(seed, 0) + 1
        room -= seed
    return found


def fractional(demand: np.ndarray, capacity: int, part: float, rate: float = 1.0, slack: float = 0.01, batch: int = 64) -> dict[tuple, float]:
    """{configuration: sequences}: a solution of the covering program, fractions included, by multiplicative weights.

    Each length has a weight, at first its count times its length to the POWER, that falls exponentially with the covered part of its
    demand; weight over demand is the price of a piece. Each round prices all rooms and raises the configurations that
    hold the ``batch`` dearest lengths, each by ``part`` of the demand that limits it (but a whole sequence where that is
    less), so that no length is covered twice. Rounds end when all but ``slack`` of every length is covered.
    """
    lengths = np.arange(len(demand))
    left = demand.astype(float)
    goal, chosen = slack * demand, {}
    while (open_ := np.flatnonzero(left > goal)).size:
        price = np.zeros(len(demand))
        price[open_] = lengths[open_] ** POWER * np.exp(rate * (left[open_] / demand[open_] - 1))
        best = room_values(price, capacity)
        for seed in open_[np.argsort(-price[open_], kind="stable")[:batch]].tolist():
            if left[seed] <= goal[seed]:
                continue
            config = configuration(seed, price, best, np.where(left > goal, np.maximum(left, 1), 0), capacity)
            limit = min(left[n] / k for n, k in config.items())
            step = min(limit, max(part * limit, 1.0))
            for n, k in config.items():
                left[n] = max(0.0, left[n] - k * step)
            key = tuple(sorted(config.items(), reverse=True))
            chosen[key] = chosen.get(key, 0.0) + step
    return chosen


def best_fit(demand: np.ndarray, capacity: int, begun: Packed = ()) -> Packed:
    """Best-fit decreasing on counts, into the sequences ``begun`` first: whole groups of like sequences take a length at a time."""
    rooms: dict[int, list[list]] = {}
    for config, sequences in begun:
        rooms.setdefault(capacity - sum(n * k for n, k in config), []).append([config, sequences])
    for n in range(capacity, 0, -1):
        left = int(demand[n]) if n < len(demand) else 0
        while left:
            room = next((r for r in range(n, capacity) if rooms.get(r)), None)
            if room is None:
                k, config = capacity // n, ()
                full, rest = divmod(left, k)
                for m, sequences in ((k, full), (rest, 1 if rest else 0)):
                    if sequences:
                        rooms.setdefault(capacity - m * n, []).append([((n, m),), sequences])
                left = 0
                continue
            config, sequences = rooms[room].pop()
            k = min(room // n, max(1, left // sequences))
            used = min(sequences, left // k)
            if used < sequences:
                rooms[room].append([config, sequences - used])
            rooms.setdefault(room - k * n, []).append([(*config, (n, k)), used])
            left -= used * k
    return [(config, sequences) for groups in rooms.values() for config, sequences in groups]


def solve(demand: np.ndarray, capacity: int = CAPACITY, part: float = 0.25, phases: int = 12) -> tuple[Packed, int]:
    """(plan, sequences of it that the program gave) for ``demand[n]`` pieces of each length n.

    A part of all tokens, in the shortest pieces, is held back from the program; best fit fills the gaps of its sequences with them
    and packs what rounding left. Of ``TRIES`` the first with the fewest sequences counts; at the bound of all tokens no more
    are made. Only counts of at most ``capacity`` lengths are used, however many pieces there are.
    """
    count = lambda plan: sum(n for _, n in plan)
    tokens = np.arange(len(demand)) * demand
    best = None
    for full, part_held in TRIES:
        held = np.where(np.cumsum(tokens) <= part_held * tokens.sum(), demand, 0)
        packed, left = programmed(demand - held, capacity, full, part, phases)
        plan = best_fit(left + held, capacity, packed), count(packed)
        if best is None or count(plan[0]) < count(best[0]):
            best = plan
        if count(best[0]) <= -(-int(tokens.sum()) // capacity):
            break
    return best


def programmed(demand: np.ndarray, capacity: int, fill: float, part: float, phases: int) -> tuple[Packed, np.ndarray]:
    """(sequences that the program gives, pieces left).

    The program's solution is rounded down, then up where whole sequences still fit the demand, the largest fractions
    first. What is left is a smaller program of its own, with whole steps, until a phase adds nothing.
    """
    left, packed = demand.astype(np.int64).copy(), []

    def take(config: tuple[tuple[int, int], ...], most: int) -> int:
        sequences = min([most, *(int(left[n]) // k for n, k in config)])
        if sequences > 0:
            for n, k in config:
                left[n] -= k * sequences
            packed.append((config, sequences))
        return max(sequences, 0)

    for phase in range(phases):
        chosen = fractional(left, capacity, 1.0 if phase else part, slack=0.0 if phase else 0.01)
        by_fill = sorted(chosen.items(), key=lambda x: -sum(n * k for n, k in x[0]))
        full = [(c, x) for c, x in by_fill if phase + 1 == phases or sum(n * k for n, k in c) >= fill * capacity]
        done = sum(take(config, int(x + 1e-9)) for config, x in full)
        done += sum(take(config, 1) for config, x in sorted(full, key=lambda x: -(x[1] % 1)) if x % 1 > 1e-9)
        if not done or not left.any():
            break
    return packed, left


def places(packed: Packed, capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, in a sequence, first sequence, offset) that deal ranks to places."""
    found: dict[int, list] = {}
    ranks, sequence = [0] * (capacity + 1), 0
    for config, sequences in packed:
        offset = 0
        for n, k in config:
            found.setdefault(n, []).append((ranks[n], k, sequence, offset))
            ranks[n] += k * sequences
            offset += n * k
        sequence += sequences
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, encoder: Encoder, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text and its end id; only the first may be shorter. ``_salt`` spreads them."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                ids, bounds = encoder(some.column("text"))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                end = size[row] - (n[row] - 1 - piece) * capacity
                start = np.maximum(end - capacity, 0)
                data = memoryview(ids.astype("<u4")).cast("B")
                spans = zip((4 * (bounds[row] + start)).tolist(), (4 * (bounds[row] + end)).tolist(), strict=True)
                crc = [zlib.crc32(data[a:b]) for a, b in spans]
                salt = mixed(np.uint64(part << 40) + np.arange(n_rows, n_rows + len(row), dtype=np.uint64)) >> np.uint64(2)
                n_rows += len(row)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64()),
                     pa.array(salt.astype(np.int64))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "_salt"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, f"{PIECE}, _salt long")


def pack(docs: DataFrame, encoder: Encoder, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A null text is empty: its piece is the end id alone. Repeated rows are packed each; a null doc_id stays null; other
    columns, whatever their names, play no part; an empty table gives an empty table. A text of any length is encoded
    whole and cut. The driver gets the histogram, at most ``capacity`` counts, and sends back the plan. Pieces of a length are ranked in salted blocks, whose sizes
    are summed before, so that no length, however common, is ranked in one task.
    """
    spark = docs.sparkSession
    every = cut(pieces(docs, encoder, end_id, capacity))
    demand = np.zeros(capacity + 1, np.int64)
    for row in every.groupBy("length").count().collect():
        demand[row["length"]] = row["count"]
    sent = spark.sparkContext.broadcast(places(solve(demand, capacity)[0], capacity))
    blocks = int(min(1 << 12, max(64, demand.sum() // 50_000)))
    every = every.withColumn("_block", F.col("_salt") % blocks)
    by_block = Window.partitionBy("length").orderBy("_block")
    firsts = every.groupBy("length", "_block").count().withColumn("_first", F.sum("count").over(by_block) - F.col("count")).drop("count")
    in_block = Window.partitionBy("length", "_block").orderBy("_salt")
    ranked = (
        every.withColumn("_n", F.row_number().over(in_block) - 1).join(firsts, ["length", "_block"])
        .withColumn("_rank", F.col("_first") + F.col("_n"))
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = plan[int(n)]
                first, k, base, at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                sequence[own] = base + (rank[own] - first) // k
                offset[own] = at + (rank[own] - first) % k * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(deal, f"{PIECE}, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, ByteEncoder(public("byte_bpe_50k.json")))
