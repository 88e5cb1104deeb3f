"""Periodic runs: word ids as bit planes of big integers, compared with themselves at a lag; stretches of equal words are runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import WORD_RE, whole
from quern.llm.words import mixed

#: Words of the shortest run.
LEAST = 12
#: Every lag below twice this is tried; longer ones only where words repeat at that lag.
SHORT = 4
#: Bytes of text that are compared at once; a longer text stands alone.
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Planes:
    """Numbers as bit planes: bit i of plane k is bit k of the i-th number."""

    def __init__(self, numbers: np.ndarray):
        self.n = len(numbers)
        width = int(numbers.max()).bit_length() if self.n else 0
        packed = (np.packbits((numbers >> k & 1).astype(np.uint8), bitorder="little") for k in range(width))
        self.planes = [int.from_bytes(x.tobytes(), "little") for x in packed]

    def stretches(self, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of all maximal stretches of at least ``least`` numbers that equal the number ``lag`` further on."""
        differ = 0
        for plane in self.planes:
            differ |= plane ^ (plane >> lag)
        long = ~differ & ((1 << max(0, self.n - lag)) - 1)
        held = 1
        while long and held < least:  # bit i says that `held` bits from i on were set
            step = min(held, least - held)
            long &= long >> step
            held += step
        return self.places(long & ~(long << 1)), self.places(long & ~(long >> 1)) + held - 1

    def places(self, bits: int) -> np.ndarray:
        if not bits:
            return np.zeros(0, np.int64)
        data = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(data, bitorder="little"))


def runs_of(numbers: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start and period; none is longer than ``longest``.

    A stretch of L numbers that equal those q further on is a run of L + q numbers if it has q numbers at least. Lags below
    ``2 * SHORT`` are all tried. A run of a longer period q, with ``2 * half <= q < 4 * half`` for some ``half`` of 4, 8, 16, ...,
    begins with q numbers that hold one of the grams of ``half`` numbers that start at multiples of ``half``, and holds that
    gram again q further on. So each gram is compared with two such grams before it, and the lags at which one is met are
    tried. If both grams lie in one run of a period up to ``half / 2``, a run of that lag would be that run, and the pair is
    passed over; without that a long run would ask for all its multiples. The work is one pass for each doubling of
    ``half`` and one for each lag tried.
    """
    planes, found, seen = Planes(numbers), [], set()

    def attempt(lag: int) -> None:
        for first, last in zip(*(x.tolist() for x in planes.stretches(lag, max(least - lag, lag))), strict=True):
            length = last - first + 1 + lag
            if (first, length) not in seen:  # else it has a smaller period, tried before
                seen.add((first, length))
                found.append((first, length, lag))

    for lag in range(1, min(2 * SHORT - 1, longest // 2) + 1):
        attempt(lag)
    grams, size, half = mixed(numbers.astype(np.uint64) * _ODD + _ODD), 1, SHORT
    while 4 * half <= longest:
        while size < half:
            grams = mixed(grams[:-size] * _ODD + grams[size:])
            size *= 2
        inside = np.zeros(len(grams), np.int64)
        for k, (start, length, period) in enumerate(found, 1):
            if 2 * period <= half <= length:
                inside[start : start + length - half + 1] = k
        before = np.repeat(grams[::half], half)
        lags = []
        for skip in (2 * half, 3 * half):
            later = grams[skip:]
            at = np.flatnonzero(later == before[: len(later)])
            there, here = at // half * half, at + skip
            lags.append((here - there)[(inside[here] == 0) | (inside[here] != inside[there])])
        for lag in np.unique(np.concatenate(lags)).tolist():
            attempt(lag)
        half *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def _runs_of_texts(texts: list[bytes | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text the number of its words, its runs and the words that stay, joined by a space."""
    words = [(text or b"").split() for text in texts]  # splits at the six characters of white space
    counts = np.array([len(x) for x in words], np.int64)
    first = np.concatenate([[0], np.cumsum(counts + 1)])  # a number of its own ends each text
    spelled = pa.chunked_array([pa.array(x, pa.large_binary()) for x in words if x], pa.large_binary()).combine_chunks().dictionary_encode()
    numbers = np.full(first[-1], -1, np.int64)
    ends = first[1:] - 1
    inner = np.ones(len(numbers), bool)
    inner[ends] = False
    numbers[inner] = spelled.indices.to_numpy()
    numbers[ends] = len(spelled.dictionary) + np.arange(len(words))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in runs_of(numbers, int(counts.max(initial=0)), least):
        row = int(np.searchsorted(first, start, "right")) - 1
        runs[row].append((start - int(first[row]), length, period))
    for own, n, found in zip(words, counts.tolist(), runs, strict=True):
        if found:
            stays = np.ones(n, bool)
            for start, length, period in found:
                stays[start + period : start + length] = False
            own = [own[k] for k in np.flatnonzero(stays).tolist()]
        yield n, found, b" ".join(own)


def _slices(texts: pa.Array) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for text in texts.cast(pa.large_binary()):
        value = text.as_py()
        if held and size + len(value or b"") > SLICE:
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value or b"")
    if held:
        yield held


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Columns of ``docs`` with collapsed texts, then ``n_words`` and ``runs`` (start, length, period; by start, then period).

    Words are what white space separates. A run is a stretch of words of smallest period q, at least ``least`` and 2q words
    long, that no neighbouring word extends. Of each run the first q words stay; a word that any run drops is dropped.
    ``text`` becomes the kept words joined by one space, in texts without runs too. A null or empty text has no words
    and becomes the empty one. Rows are judged one by one, so repeated rows give repeated results, and an empty table
    an empty one. Input columns named n_words or runs are replaced; others are kept, whatever their names. A very long
    text takes time and memory in proportion to its words and to the lags that it repeats at. There is no shuffle.
    """
    names = [c for c in docs.columns if c not in ("n_words", "runs")]
    held = [f"c{k}" for k in range(len(names))]  # names with dots are none for Arrow functions
    kinds = [T.StructField(c, T.StringType() if name == "text" else docs.schema[name].dataType) for c, name in zip(held, names, strict=True)]
    of_run = T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in RUN]))
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("runs", of_run)])
    place = names.index("text")

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, bounds, texts = [], [], [0], []
            for part in _slices(batch.column(place)):
                for n, found, text in _runs_of_texts(part, least):
                    counts.append(n)
                    runs += found
                    bounds.append(len(runs))
                    texts.append(text)
            flat = np.array(runs, np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            columns += [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, held, strict=True)]).mapInArrow(collapsed, schema).toDF(*names, "n_words", "runs")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a run in each text whose doc_id's crc32 ends in 0: from word a on the p words there repeat to the end.

    With g the rest of that number's digits and n words, ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``. A null doc_id
    or a text without words has none.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(whole(F.col("text")), F.lit(WORD_RE), F.lit(0))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted: Column = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
