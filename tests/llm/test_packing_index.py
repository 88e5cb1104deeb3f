"""Packing, the token index and mixing against plain Python."""

import zlib
import random
from collections import Counter, defaultdict
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm.packing import CAPACITY, best_fit, op5_packing, pack, pieces, places, solve
from quern.llm.shared import new_path
from quern.llm.token_index import Shard, build_index, key_hash, op9_token_index, read_index, write_index
from quern.llm import token_index, tokens
from quern.llm.tokens import ByteEncoder, WordEncoder, public
from quern.llm.words import unit_keys


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    return Tokenizer.from_file(public(name))


def ids_of(encoder, texts):
    ids, bounds = encoder(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())]


def check_packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(by)


def test_op5(spark, sf_dir):
    rows = op5_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    encoded = tokenizer("byte_bpe_50k.json").encode_batch([d.text or "" for d in docs], add_special_tokens=False)
    expected = Counter()
    for d, e in zip(docs, encoded, strict=True):
        ids = [*e.ids, 0]
        first = len(ids) % CAPACITY or CAPACITY
        cuts = [0, *range(first, len(ids) + 1, CAPACITY)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[(d.doc_id, k, a, b - a, crc(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    total = sum(r.length for r in rows)
    assert check_packed(rows) <= -(-total // CAPACITY) * 1.01 + 1


def test_pack_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 5000, 0), (None, "a", 0), (3, "word " * 5000, 0), (4, "a", 0)], "doc_id long, text string, piece int")
    rows = pack(docs, ByteEncoder(public("byte_bpe_50k.json"))).collect()
    check_packed(rows)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert len([r for r in rows if r.doc_id == 3 and r.piece == 1]) == 2
    assert pack(docs.limit(0), ByteEncoder(public("byte_bpe_50k.json"))).count() == 0


def test_the_program_packs_most(spark, sf_dir):
    demand = np.zeros(CAPACITY + 1, np.int64)
    encoder = ByteEncoder(public("byte_bpe_50k.json"))
    for row in pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoder).groupBy("length").count().collect():
        demand[row["length"]] = row["count"]
    for times in (1, 1000):
        packed, given = solve(demand * times)
        total, bound = sum(k for _, k in packed), -(-int(demand @ np.arange(CAPACITY + 1)) * times // CAPACITY)
        assert given >= 0.9 * total and total <= 1.01 * bound


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_solve_packs_every_piece(counts):
    demand = np.zeros(65, np.int64)
    for n, k in counts.items():
        demand[n] = k
    packed, given = solve(demand, 64)
    assert 0 <= given <= sum(k for _, k in packed)
    done = np.zeros(65, np.int64)
    for config, sequences in packed:
        assert sum(n * k for n, k in config) <= 64
        for n, k in config:
            done[n] += k * sequences
    assert (done == demand).all()
    assert sum(k for _, k in packed) <= sum(k for _, k in best_fit(demand, 64)) * 1.1 + 1
    assert {n: int((rows[:, 1] > 0).sum()) for n, rows in places(packed, 64).items()}.keys() == counts.keys()


ODD = list(" \n\t'abAB09.,!<|>é\u00a0\u3000ß\u0301\x01\x1c\r\x0bst") + ["<|endoftext|>", "<|startoftext|>", "'s", "  ", "\n\n", "ﬁ", "中", "İ", "\u2003", "\u0100"]


@pytest.mark.parametrize(("encoder", "name"), [(WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json")])
def test_encoders_give_the_tokenizers_ids(encoder, name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["hello <|endoftext|> world", "  <|endoftext|>  x", "a" * 5000, " " * 100_000 + "x", "word " * 20_000, "é" * 3000, "9" * 700 + "'re", "", None]
    expected = [e.ids for e in tokenizer(name).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert ids_of(encoder(public(name)), texts) == expected
    assert ids_of(encoder(public(name)), texts) == expected  # from what is kept


@pytest.mark.parametrize(("encoder", "name"), [(WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json")])
def test_encoders_survive_a_full_store_and_equal_keys(monkeypatch, encoder, name):
    texts = [f"word{k} other{k}, énd{k}" for k in range(300)] + ["common words again"] * 3
    expected = [e.ids for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "_kept", {})
    monkeypatch.setattr(tokens, "CACHED_UNITS", 50)
    got = [x for k in range(0, len(texts), 20) for x in ids_of(encoder(public(name)), texts[k : k + 20])]
    assert got == expected
    # a forged first key: all units of a length share it, the second tells them apart
    monkeypatch.setattr(tokens, "_kept", {})
    monkeypatch.setattr(tokens, "unit_keys", lambda data, starts, ends: ((ends - starts).astype(np.uint64), unit_keys(data, starts, ends)[1]))
    assert ids_of(encoder(public(name)), texts) == expected


def test_op9(spark, sf_dir):
    rows = {r.doc_id: r for r in op9_token_index(spark, sf_dir).collect()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    start = 0
    encoded = tokenizer("word_bpe_49k.json").encode_batch([d.text or "" for d in docs], add_special_tokens=False)
    for d, e in zip(docs, encoded, strict=True):
        ids, r = [*e.ids, 1], rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(docs)


def test_index_edge_cases(spark):
    rows = [(5, "b c", 1), (None, "null id", 1), (1, None, 1), (5, "a", 1), (5, "a", 1), (2, "", 1), (-7, "x " * 3000, 1), (5, "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for shard_docs, shard_ids in ((2, 10**6), (100, 10), (100, 10**6)):
        folder = new_path(spark, "tokens")
        manifest = write_index(docs, folder, WordEncoder(public("word_bpe_49k.json")), shard_docs=shard_docs, shard_ids=shard_ids)
        rows = sorted((r.start, r.doc_id, r.n_tokens) for r in read_index(spark, folder).collect())
        assert [r[1] for r in rows] == [None, -7, 1, 2, 5, 5, 5, 5] and [r[2] for r in rows][:4] == [3, 3001, 1, 1]
        assert sorted(r[2] for r in rows[4:]) == [2, 2, 2, 3]
        assert all(a[0] + a[2] == b[0] for a, b in pairwise(rows))
    shard = Shard(manifest.first().path)
    known, _, _ = shard.locate(key_hash(np.arange(10**6, 10**6 + 50), np.zeros(50), np.zeros(50, bool)))
    assert not known.any()
    empty = new_path(spark, "tokens")
    write_index(docs.limit(0), empty, WordEncoder(public("word_bpe_49k.json")))
    assert read_index(spark, empty).count() == 0


def test_a_damaged_shard_is_an_error(spark):
    folder = new_path(spark, "tokens")
    path = write_index(spark.createDataFrame([(k, "x") for k in range(40)], "doc_id long, text string").coalesce(1), folder, WordEncoder(public("word_bpe_49k.json"))).first().path
    local = path.removeprefix("file://")
    data = bytearray(Path(local).read_bytes())
    n_buckets = int(np.frombuffer(data[16:24], "<u8")[0])
    data[40 + 4 * n_buckets] ^= 255  # a fingerprint
    Path(local).write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        read_index(spark, folder).collect()


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError, match="one hash"):
        build_index(np.array([3, 4, 3], np.uint64))


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    h = key_hash(np.arange(n) * 7919, np.zeros(n), np.zeros(n, bool))
    _, slots = build_index(h)
    assert sorted(slots.tolist()) == list(range(n))


def test_no_more_sequences_than_best_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    demand = np.zeros(CAPACITY + 1, np.int64)
    for row in pieces(docs, ByteEncoder(public("byte_bpe_50k.json"))).groupBy("length").count().collect():
        demand[row["length"]] = row["count"]
    packed, given = solve(demand)
    made = sum(n for _, n in packed)
    assert made <= sum(n for _, n in best_fit(demand, CAPACITY)) and given >= 0.9 * made
    filled = np.zeros_like(demand)
    for config, n in packed:
        assert sum(length * k for length, k in config) <= CAPACITY
        for length, k in config:
            filled[length] += k * n
    assert (filled == demand).all()


def test_keys_of_one_hash_are_parted_by_another_seed(spark, tmp_path, monkeypatch):
    plain = token_index.key_hash
    clash = lambda ids, repeats, absent, seed=0: plain(ids, repeats, absent, seed) if seed else np.where(ids < 2, np.uint64(7), plain(ids, repeats, absent, 0))
    monkeypatch.setattr(token_index, "key_hash", clash)
    ids, absent = np.arange(40), np.zeros(40, bool)
    length = np.arange(40) % 3 + 1
    payload = [np.arange(int(length.sum()), dtype=np.uint32)]
    shard = Shard(token_index._write(f"file://{tmp_path}", ids, absent, length, payload))
    assert shard.seed == 1
    known, offset, size = shard.find(ids, np.zeros(40, np.int64), absent)
    assert known.all() and (size == length).all() and (offset == np.cumsum(length) - length).all()
    assert not shard.find(np.arange(1000, 1050), np.zeros(50, np.int64), np.zeros(50, bool))[0].any()
