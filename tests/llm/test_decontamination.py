import random
import re
import time

import pytest

from quern.llm import decontamination
from quern.llm.decontamination import OP12_SQL, contamination, op12_decontamination, without_contaminated, without_spans
from tests.oracle import same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """{(doc_id, text): (n_words, hit words, items)} by comparing each window at each place."""
    found = {}
    for doc_id, text in docs:
        own, hit, listed = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(len(w), window)
            for k in range(len(w) - n + 1) if n else []:
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == w[k : k + n]:
                        hit |= set(range(i, i + n))
                        listed |= {str(item_id)} if item_id is not None else set()
        found[doc_id, text] = (len(own), sorted(hit), sorted(listed))
    return found


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return {(r.doc_id, r.text): (r.n_words, list(r.hit_words), list(r["items"])) for r in df.collect()}


def test_query_against_sql(spark, sf_dir):
    assert same_rows(op12_decontamination(spark, sf_dir), OP12_SQL, sf_dir) > 0
    assert op12_decontamination(spark, sf_dir).where("contaminated").count() > 0


@pytest.mark.parametrize("large", [False, True])
def test_random_texts(spark, monkeypatch, large):
    if large:  # nothing may be broadcast
        monkeypatch.setattr(decontamination, "SMALL_WINDOWS", 0)
        monkeypatch.setattr(decontamination, "SMALL_BLOCKS", 0)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 20])][3:]
    docs = [(k, say(rng.randrange(45))) for k in range(60)]
    assert rows(contamination(*tables(spark, docs, items))) == plain(docs, items)


def test_edges(spark):
    passage = "Über den Fluß; the OLD bridge, hält no-one 42 back à jamais!"
    items = [(1, passage), (10, passage), (2, None), (3, ""), (4, " .,"), (5, "Eins\x00Zwei"), (None, "nobody lists this")]
    docs = [
        (1, f"Before it. {passage.replace(' ', '\n')} After"), (2, passage.replace("Ü", "ü")), (None, "eins zwei, EINS-ZWEI"), (3, None), (4, ""),
        (5, "Nobody lists THIS."), (6, "nobody lists this"), (7, "eins zwei"), (7, "eins zwei"), (7, "eins drei"), (8, "...;\n"),
    ]
    d, b = tables(spark, docs, items)
    got = contamination(d, b)
    assert got.count() == len(docs)
    assert rows(got) == plain(docs, items)
    assert rows(got)[1, docs[0][1]][2] == ["1", "10"]
    clash = contamination(d.selectExpr("doc_id", "text", "'x' AS items", "1 AS `a.b`", "2 AS _words", "3 AS _k1"), b)
    assert clash.columns == ["doc_id", "text", "a.b", "_words", "_k1", "n_words", "hit_words", "items"]
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).where("size(hit_words) > 0").count() == 0
    left = {(r.doc_id, r.text) for r in without_spans(d, b).collect()}
    assert {(1, "Before it! After"), (None, ""), (5, "."), (8, "...;\n"), (3, None), (7, "eins drei")} <= left
    assert sorted(r.doc_id for r in without_contaminated(d, b).collect()) == [3, 4, 6, 7, 8]


def test_very_long_texts(spark):
    text = "word " * 400_000 + "one two three four five six seven eight nine ten " + "x" * 400_000
    began = time.time()
    ((n, hit, listed),) = rows(contamination(*tables(spark, [(1, text)], [(9, "One two three, four five six seven eight nine ten.")]))).values()
    assert time.time() - began < 60
    assert (n, hit, listed) == (400_011, list(range(400_000, 400_010)), ["9"])
