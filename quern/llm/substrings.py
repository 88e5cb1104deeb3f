"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata and located in all documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import cut, whole
from quern.llm.words import mixed, slices, spans, unit_keys, windows

#: Words of a window, and of the phrase that stands for it: of its phrases the one with the smallest hash.
WINDOW, PHRASE = 35, 16
#: Text of a shard of documents, and words a range of hashes answers for (both about).
SHARD_BYTES, RANGE_WORDS = 8 << 20, 1 << 20
#: Hashes that a task gathers before it hands them on.
GATHERED = 1 << 20
#: Phrases that one automaton holds at most; a shard with more streams through several.
AUTOMATON_PHRASES = 100_000
_TWIST = np.uint64(0xD6E8FEB86659FD93)


def smallest(h: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest of every ``n`` consecutive values, the first of equals."""
    at, span = np.arange(len(h)), 1
    while span < n:
        step = min(span, n - span)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        span += step
    return at


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Words:
    """The words of consecutive rows: two keys of each, rows, the starts of windows, and the hashes of phrases."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, phrase: int):
        self.starts, self.ends, self.first = spans(data, at)
        self.h, self.g = unit_keys(data, self.starts, self.ends)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        n = len(self.h) - window + 1
        self.windows = np.flatnonzero(self.row[:n] == self.row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.phrases = windows(self.h, phrase)

    def chosen(self, window: int, phrase: int) -> np.ndarray:
        """For each window, the place of the phrase that stands for it: the same in equal windows."""
        return smallest(self.phrases, window - phrase + 1)[self.windows] if len(self.windows) else self.windows

    def digests(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every window, from both keys of its words."""
        return windows(self.h, window), windows(self.g, window)


def _in_ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)  # chosen hashes are small ones


def _once(shard: np.ndarray, h: np.ndarray, g: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, range, h, g, whether it came several times): each shard's digests in order, once each."""
    part = _in_ranges(h, ranges)
    order = np.lexsort((g, h, part, shard))
    shard, part, h, g = shard[order], part[order], h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (shard[1:] != shard[:-1])
    firsts = np.flatnonzero(new)
    several = np.diff(np.append(firsts, len(h))) > 1
    return shard[firsts], part[firsts], h[firsts], g[firsts], several


def _sent(shard: np.ndarray, h: np.ndarray, g: np.ndarray | None, ranges: int) -> pa.RecordBatch:
    """(range, shard, digests) rows: each shard's digests for a range; the last bit tells of several."""
    last = h if g is None else g
    clear = last & ~np.uint64(1)
    shard, part, h, g2, several = _once(shard, clear if g is None else h, np.zeros(len(h), np.uint64) if g is None else clear, ranges)
    both = h | several if g is None else np.stack([h, g2 | several], axis=1)
    edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(shard) != 0)) + 1
    firsts = np.concatenate([[0], edges]) if len(h) else np.zeros(0, np.int64)
    parts = [both[a:b].tobytes() for a, b in pairwise([*firsts.tolist(), len(h)])] if len(h) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(part[firsts].astype(np.int32)), pa.array(shard[firsts].astype(np.int32)), pa.array(parts, pa.binary())],
        ["range", "shard", "digests"],
    )


SENT = "range int, shard int, digests binary"


def recurring(sent: DataFrame) -> DataFrame:
    """(shard, digests): the hashes that each shard sent which were found at least twice, in any shards; the last bit is 0.

    A range gets one of a hash from a batch of a shard, so a passage that all documents hold adds as many hashes as
    there are shards, not documents.
    """

    def find(group: pa.Table) -> pa.Table:
        parts = group["digests"].to_pylist()
        every = np.frombuffer(b"".join(parts), "<u8")
        owner = np.repeat(group["shard"].to_numpy(), [len(x) // 8 for x in parts])
        several, every = (every & np.uint64(1)).astype(np.int64), every & ~np.uint64(1)
        order = np.lexsort((owner, every))
        every, owner, several = every[order], owner[order], several[order]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        run = np.cumsum(new) - 1
        keep = np.bincount(run, 1 + several)[run] > 1
        keep[1:] &= new[1:] | (owner[1:] != owner[:-1])
        every, owner = every[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        every, owner = every[order], owner[order]
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else [0]
        return pa.table(
            [pa.array(owner[edges[:-1]].astype(np.int32)), pa.array([every[a:b].tobytes() for a, b in pairwise(edges)], pa.binary())], ["shard", "digests"]
        )

    return sent.groupBy("range").applyInArrow(find, "shard int, digests binary")


def confirmed_bits(sent: DataFrame) -> DataFrame:
    """(shard, range, digests): for each digest of a message, in its order, a bit that tells whether it was found twice."""

    def find(group: pa.Table) -> pa.Table:
        parts = group["digests"].to_pylist()
        every = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        several, g = (every[:, 1] & np.uint64(1)).astype(np.int64), every[:, 1] & ~np.uint64(1)
        order = np.lexsort((g, every[:, 0]))
        new = np.ones(len(every), bool)
        new[1:] = (every[order[1:], 0] != every[order[:-1], 0]) | (g[order[1:]] != g[order[:-1]])
        run = np.cumsum(new) - 1
        twice = np.zeros(len(every), bool)
        twice[order] = np.bincount(run, 1 + several[order])[run] > 1
        bounds = np.cumsum([0, *(len(x) // 16 for x in parts)]).tolist()
        return pa.table([group["shard"], group["range"], pa.array([np.packbits(twice[a:b]).tobytes() for a, b in pairwise(bounds)], pa.binary())], ["shard", "range", "digests"])

    return sent.groupBy("range").applyInArrow(find, "shard int, range int, digests binary")


def _hashes_of(table: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(table["digests"].to_pylist()), "<u8"))


class Alphabet:
    """Spells words by their number among the distinct words of the passages; all other words are spelled alike.

    A word is three characters (more, where there are over 64^3 words), each place with 64 of its own: few children keep
    the automaton's nodes narrow, own ones keep words in step.
    """

    def __init__(self, h: np.ndarray, g: np.ndarray):
        self.key, first = np.unique(mixed(h ^ (g * _TWIST)), return_index=True)
        self.h, self.g = h[first], g[first]
        at = np.searchsorted(self.key, mixed(h ^ (g * _TWIST)))
        if (self.h[at] != h).any() or (self.g[at] != g).any():
            raise ValueError("two words of a shard share a 64-bit key of both their keys")
        self.width = max(3, -(-int(len(self.key) + 2).bit_length() // 6))

    def spelled(self, words: Words) -> str:
        """The words of all rows, an edge (its first character is of no word) between two rows."""
        number = np.zeros(len(words.h), np.int64)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, mixed(words.h ^ (words.g * _TWIST))), len(self.key) - 1)
            number = np.where((self.h[at] == words.h) & (self.g[at] == words.g), at + 1, 0)
        parts = np.stack([(number >> (6 * k) & 63) + (0, 64, 128, 192)[k % 4] for k in range(self.width)], axis=1).astype(np.uint8)
        return np.insert(parts, words.first[1:-1], 255, axis=0).tobytes().decode("latin-1")


class Passages:
    """The confirmed windows of a shard as words, compiled into automata of the phrases that stand for them.

    An automaton finds a phrase; the windows that hold it, by where in them it stands, are then looked up in the text around
    the hit, word by word. A hit costs one look-up for each such place, however many windows share the phrase.
    """

    def __init__(self, window: int, phrase: int, width: int):
        self.window, self.phrase, self.width = window, phrase, width
        self.by_phrase: dict[str, dict[int, set[str]]] = {}

    def add(self, text: str, starts: np.ndarray, at: np.ndarray) -> None:
        """The windows of ``text`` at these starts, and the places of the phrases that stand for them."""
        n = self.width
        for start, place in zip((n * starts).tolist(), (n * at).tolist(), strict=True):
            held = self.by_phrase.setdefault(text[place : place + n * self.phrase], {})
            held.setdefault(place - start, set()).add(text[start : start + n * self.window])

    def automata(self) -> Iterator:
        import ahocorasick

        phrases = list(self.by_phrase)
        for i in range(0, len(phrases), AUTOMATON_PHRASES):
            machine = ahocorasick.Automaton()
            for x in phrases[i : i + AUTOMATON_PHRASES]:
                machine.add_word(x, list(self.by_phrase[x].items()))
            machine.make_automaton()
            yield machine

    def cover(self, machine, text: str, change: np.ndarray) -> None:
        """Add +1 where a covered stretch of ``text`` begins and -1 where it ends."""
        window, back, covered = self.width * self.window, self.width * self.phrase - 1, []
        for end, places in machine.iter(text):
            for before, held in places:
                start = end - back - before
                if start >= 0 and text[start : start + window] in held:
                    covered.append(start)
        starts = np.array(covered, np.int64) // self.width
        np.add.at(change, starts, 1)
        np.subtract.at(change, starts + self.window, 1)


def kept_words(data: np.ndarray, words: Words, covered: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the words that aren't covered, joined by one space a row."""
    keep = np.flatnonzero(~covered)
    last = np.ones(len(keep), bool)
    last[:-1] = words.row[keep[1:]] != words.row[keep[:-1]]
    change = np.zeros(len(data) + 1, np.int8)
    change[words.starts[keep]] += 1
    change[words.ends[keep]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    out, spaces = data.copy(), words.ends[keep[~last]]
    out[spaces], mask[spaces] = 32, True
    sizes = np.bincount(words.row[keep], words.ends[keep] - words.starts[keep] + ~last, rows).astype(np.int64)
    return out[mask], np.concatenate([[0], np.cumsum(sizes)])


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Columns of ``docs`` with the remaining words joined by one space as ``text``, then ``n_words`` (before), ``n_removed``.

    A word goes if a window of ``window`` consecutive words of one row covers it whose word sequence starts anywhere
    else, in this row or another; windows are judged on the input. A null or empty text has no words and becomes empty;
    rows are judged one by one, so repeated rows empty each other if they have a window; a null doc_id is as any other.
    Input columns named n_words or n_removed are replaced. An empty table gives an empty table. A very long text is one
    row of one shard.

    Each window is stood for by its phrase of the smallest hash, so that equal windows share it. (1) Tasks send the
    chosen phrases' hashes to hash ranges, which answer to each shard of documents which of its phrases recur.
    (2) Shards send digests of 127 bits of the windows on such phrases, and get a bit for each that recurs: these are confirmed.
    (3) Each shard reads the confirmed passages off where they stand and compiles them into automata, of which none holds
    more than AUTOMATON_PHRASES phrases; all its documents stream through them, and the windows that a hit finds, compared
    word by word, are removed. A shard hears of a passage once, however many documents hold it; no passage, however common,
    meets in one task.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards, ranges = max(64, size // SHARD_BYTES), max(64, size // (6 * RANGE_WORDS))
    docs = docs.select(*names, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("_shard"))
    texts = docs.select("_shard", "text")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            shard, h = (np.concatenate(x) for x in zip(*held, strict=True))
            return _sent(shard, h, None, ranges)

        for batch in batches:
            shard = batch.column("_shard").to_numpy()
            for i, _, data, at in slices(batch.column("text")):
                words = Words(data, at, window, phrase)
                own = np.unique(words.chosen(window, phrase))
                held.append((shard[i + words.row[own]], words.phrases[own]))
                n += len(own)
                if n >= GATHERED:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()

    def candidates(words: Words, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows on recurring phrases, and the places of these."""
        at = words.chosen(window, phrase)
        own = np.flatnonzero(within(words.phrases[at] & ~np.uint64(1), again))
        return words.windows[own], at[own]

    def confirm(group: pa.Table, known: pa.Table) -> pa.Table:
        again, held = _hashes_of(known), [np.zeros((2, 0), np.uint64)]
        for chunk in group["text"].chunks if len(again) else ():
            for _, _, data, at in slices(chunk):
                words = Words(data, at, window, phrase)
                own, _ = candidates(words, again)
                if len(own):
                    held.append(np.stack([x[own] for x in words.digests(window)]))
        h, g = np.concatenate(held, axis=1)
        shard = group["_shard"][0].as_py() if group.num_rows else 0
        return pa.Table.from_batches([_sent(np.full(len(h), shard), h, g, ranges)])

    def confirmed(digests: list[np.ndarray], bits: pa.Table) -> list[np.ndarray]:
        """Which windows are confirmed: digests fall into the order in which they were sent, and take the bits of their range."""
        if not digests:
            return []
        h, g = np.concatenate(digests, axis=1)
        g = g & ~np.uint64(1)
        _, part, once_h, once_g, _ = _once(np.zeros(len(h), np.int64), h, g, ranges)
        yes = np.zeros(len(once_h), bool)
        for r, packed in zip(bits["range"].to_pylist(), bits["digests"].to_pylist(), strict=True):
            a, b = np.searchsorted(part, [r, r + 1])
            yes[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        # each window looks its digest up among those sent
        own_part = _in_ranges(h, ranges)
        order = np.lexsort((g, h, own_part))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        found = np.zeros(len(h), bool)
        found[order] = yes[np.cumsum(new) - 1]
        return np.split(found, np.cumsum([x.shape[1] for x in digests])[:-1])

    def locate(group: pa.Table, known: pa.Table) -> pa.Table:
        which = known["kind"].to_numpy()
        again, bits = _hashes_of(known.filter(pa.array(which == 0))), known.filter(pa.array(which == 1))
        group = group.combine_chunks()
        column = pa.concat_arrays(group["text"].chunks) if group.num_rows else pa.array([], pa.string())
        parts = [(i, j, data, Words(data, at, window, phrase)) for i, j, data, at in slices(column)]
        spots = [candidates(words, again) if bits.num_rows else (np.zeros(0, np.int64),) * 2 for _, _, _, words in parts]
        sure = confirmed([np.stack([x[own] for x in words.digests(window)]) for (_, _, _, words), (own, _) in zip(parts, spots, strict=True) if len(own)], bits)
        sure = iter(sure)
        spots = [(own[keep], at[keep]) if len(own) else (own, at) for own, at in spots for keep in [next(sure) if len(own) else None]]
        held = [_stretches(len(words.h), own, window) for (_, _, _, words), (own, _) in zip(parts, spots, strict=True)]
        joined = lambda keys: np.concatenate([np.zeros(0, np.uint64), *(x[mask] for x, mask in zip(keys, held, strict=True))])
        alphabet = Alphabet(joined([x[3].h for x in parts]), joined([x[3].g for x in parts]))
        passages, shown = Passages(window, phrase, alphabet.width), []
        for (_, _, _, words), (own, at) in zip(parts, spots, strict=True):
            text = alphabet.spelled(words)
            shown.append(text)
            passages.add(text, own + words.row[own], at + words.row[at])
        changes = [np.zeros(len(text) // alphabet.width + 1, np.int32) for text in shown]
        for machine in passages.automata():
            for text, change in zip(shown, changes, strict=True):
                passages.cover(machine, text, change)
        texts, counts, gone = [], np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for (i, j, data, words), change in zip(parts, changes, strict=True):
            covered = np.cumsum(change[:-1])[np.arange(len(words.h)) + words.row] > 0
            counts[i:j] = np.diff(words.first)
            gone[i:j] = np.bincount(words.row[covered], minlength=j - i)
            out, bounds = kept_words(data, words, covered, j - i)
            texts.append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string()))
        kept = pa.chunked_array(texts, pa.string()) if texts else pa.chunked_array([pa.array([], pa.string())])
        columns = [kept if c == "text" else group[c] for c in names]
        return pa.table([*columns, pa.array(counts), pa.array(gone)], [*names, "n_words", "n_removed"])

    by_shard = texts.withColumn("text", whole(F.col("text")))
    again = cut(recurring(by_shard.select("_shard", "text").mapInArrow(phrases, SENT)))
    found = confirmed_bits(by_shard.groupBy("_shard").cogroup(again.groupBy("shard")).applyInArrow(confirm, SENT))
    known = again.withColumns({"range": F.lit(-1), "kind": F.lit(0)}).unionByName(found.withColumn("kind", F.lit(1)))
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields if f.name != "_shard"]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    whole_docs = docs.withColumn("text", whole(F.col("text")))
    return whole_docs.groupBy("_shard").cogroup(known.groupBy("shard")).applyInArrow(locate, schema)


def _stretches(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` places lie within ``length`` from one of the starts."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.subtract.at(change, starts + length, 1)
    return np.cumsum(change[:-1]) > 0


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM texts WHERE len(words) >= 35),
keyed AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 34], ' ')) AS k FROM starts),
again AS (SELECT k FROM keyed GROUP BY k HAVING count(*) >= 2),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM keyed SEMI JOIN again ON keyed.k = again.k),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM texts),
counted AS (
  SELECT e.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY e.pos) FILTER (c.pos IS NULL) AS kept
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
