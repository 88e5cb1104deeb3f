import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from quern.llm import runs
from quern.llm.runs import Planes, collapse_runs, op11_periodic_runs, runs_of


def plain_runs(words, least=12):
    """All runs by trying every lag at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = text.encode().split() if text else []
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    lost = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    shown = best + (1000 * best[1] // best[2],) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in lost)))


def test_runs_against_every_lag():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(0, 220)
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 8, 1000])) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # planted runs, nested and side by side
            if n > 4:
                a, p = rng.randrange(n), rng.randrange(1, 40)
                for i in range(a + p, min(n, a + p * rng.randrange(2, 9))):
                    words[i] = words[i - p]
        got = runs_of(np.array(words, np.int64), n)
        assert got == plain_runs(words), words


def test_periodic_words_and_powers():
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    squares = ["a"]
    for letter in "bcdefgh":
        squares.append(squares[-1] * 3 + letter)
    for word in [fib[-1], squares[-1], squares[-1] * 2, "a" * 700, "ab" * 300 + "c" + "ab" * 300, ("a" * 40 + "b") * 12]:
        assert runs_of(np.frombuffer(word.encode(), np.uint8).astype(np.int64), len(word)) == plain_runs(word)


def test_bit_planes_decide(monkeypatch):
    words = np.array([1, 2, 3] * 6, np.int64)
    assert runs_of(words, 18) == [(0, 18, 3)]
    monkeypatch.setattr(Planes, "stretches", lambda self, lag, least: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert runs_of(words, 18) == []


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 8000]  # trying every lag is quadratic
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert len(docs) > 900
    assert [got[d[0]] for d in docs] == [plain(*d) for d in docs]
    assert sum(r[1] > 0 for r in got.values()) > 50


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "x " * 30), (5, "a b " * 6), (5, "a b " * 6), (6, "é É " * 7 + "\x0bz"), (30, "solo"), (7, "a b c " * 9), (8, "x " * 11)]
    df = spark.createDataFrame([(*r, "kept", 9) for r in rows], "doc_id long, text string, runs string, w int").withColumnRenamed("w", "n.w")
    got = collapse_runs(df)
    assert got.columns == ["doc_id", "text", "n.w", "n_words", "runs"]
    by = [(r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs]) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(by, key=key) == sorted([
        (1, "", 0, []), (2, "", 0, []), (3, "", 0, []), (None, "x", 30, [(0, 30, 1)]), (5, "a b", 12, [(0, 12, 2)]), (5, "a b", 12, [(0, 12, 2)]),
        (6, "é É z", 15, [(0, 14, 2)]), (30, "solo", 1, []), (7, "a b c", 18, [(0, 18, 2)]), (8, " ".join("x" * 11), 11, []),
    ], key=key)
    assert collapse_runs(df.limit(0)).count() == 0
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)


@pytest.mark.parametrize("word", ["x ", "a b c ", None])
def test_very_long_texts_take_time_in_proportion(word):
    rng = np.random.default_rng(1)
    text = (word * 1_000_000)[:3_000_000] if word else " ".join(map(str, rng.integers(0, 5000, 600_000).tolist()))
    began = time.time()
    ((n, found, _),) = list(runs._runs_of_texts([text.encode()], 12))
    assert time.time() - began < 30
    assert n == len(text.split())
    assert found == ([(0, n, len(word.split()))] if word else [])
