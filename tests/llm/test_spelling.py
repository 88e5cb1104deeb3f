import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import spelling
from quern.llm.spelling import first_difference, near_pairs, near_words, op13_spelling_variants, roots, spelling_variants, with_lost_letters


def plain_words(docs):
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run


def plain(counts):
    """The rows by making all words that lack one letter."""
    lacking, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for p in range(len(w)):
            lacking[p, w[:p], w[p + 1 :]].add(w)
            short = w[:p] + w[p + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    for group in lacking.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in Counter(plain_words(docs)).items() if len(w) >= 5 and n >= 3}
    expected = plain(counts)
    assert got(op13_spelling_variants(spark, sf_dir)) == expected
    assert sum(r[1] is not None for r in expected) > 100 and any(r[1] != r[2] for r in expected if r[1])


@pytest.mark.parametrize("most", [1, 7, 256])
def test_blocks_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (most,))
    rng = random.Random(most)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 60) for _ in range(900)}
    counts |= {"stem" + c + "word": 5 for c in "abcdefghijklmnopqrstuvwxyzäöüßéèê"} | {"stemword": 70, "éa": 4, "ea": 9}
    assert got(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_pairs_meet_in_one_block():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        k, edit = rng.randrange(len(a)), rng.choice("ab")
        b = rng.choice([a[:k] + edit + a[k + 1 :], a[:k] + a[k + 1 :], a[:k] + edit + a[k:]])
        if a == b or not b:
            continue
        short, more = min(len(a), len(b)), int(len(a) != len(b))
        for split in range(1, short + 1):
            found = [list(near_pairs([(a, 1), (b, 2)], short, more, lo, hi)) for lo, hi in ((0, split), (split, short + more)) if a[:lo] == b[:lo]]
            assert sum(map(len, found)) == 1, (a, b, split)
    assert first_difference("abcd", "abxd", 1, 4) == 2
    assert first_difference("abcd", "abcdz", 0, 5) == 4


def test_scans_of_dictionaries_decide(spark, monkeypatch):
    words = spark.createDataFrame([("colour", 9), ("color", 3)], "word string, n long")
    assert got(spelling_variants(words)) == {("colour", None, "colour", 9, 1, None), ("color", "colour", "colour", 3, 1, 9)}
    monkeypatch.setattr(spelling, "_blocks", lambda entries: entries.selectExpr("*", "'' AS prefix", "word AS suffix"))
    assert {r[4] for r in got(spelling_variants(words))} == {0}


def test_chains_of_forms(spark):
    chain = [("w" * 5 + "x" * k, 3 * 2**k) for k in range(20)]
    rows = got(spelling_variants(spark.createDataFrame(chain, "word string, n long")))
    assert {r[2] for r in rows} == {chain[-1][0]} and len(rows) == 20
    forms = spark.createDataFrame([(str(k), str(k + 1)) for k in range(100)] + [("x", "50")], "word string, form string")
    assert {(r.word, r.root) for r in roots(forms).collect()} == {(str(k), "100") for k in range(100)} | {("x", "100")}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  123 "), (None, "Grüße grüße GRÜßE GRÜSSE"), (4, "Éclair éclair"), (4, "Éclair éclair"), (5, "a" * 30_000 + " ×÷×÷×"), (6, "a" * 30_000), (7, "a" * 30_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.word for r in with_lost_letters(docs).collect()) == Counter(plain_words(rows))
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).count() == 0 and near_words(none).count() == 0
    long = {"a" * 30_000: 9, "a" * 30_001: 4, "b" + "a" * 29_999: 4, "a" * 15_000 + "b" + "a" * 14_999: 5, "a" * 29_999: 9}
    began = time.time()
    rows = {r.word: (r.form, r.n_near) for r in spelling_variants(spark.createDataFrame(list(long.items()), "word string, n long")).collect()}
    assert time.time() - began < 60
    a = "a" * 30_000
    assert rows == {a: (None, 4), a + "a": (a, 1), "b" + a[1:]: (a[1:], 2), a[:15_000] + "b" + a[15_001:]: (None, 2), a[1:]: (None, 3)}
