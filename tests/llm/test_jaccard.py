"""The n-gram Jaccard join against SQL and against all pairs in plain Python."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import jaccard_join
from quern.llm.jaccard_join import (
    DEPTH, LEAST, TREES, components, jaccard_classes, one_of_each, op8_jaccard_join, paths, prefix_length, prefixes, recall_at, shingles, signatures, trie_links,
)
from quern.llm.queries import ORACLE_SQL
from quern.llm.words import slices
from tests.oracle import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= LEAST * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((rows[i][0], rows[find(i)][0], links[i]) for i in range(len(rows)))


def test_op8_equals_sql(spark, sf_dir):
    assert same_rows(op8_jaccard_join(spark, sf_dir), ORACLE_SQL["op8_jaccard_join"], sf_dir) == 1000


@pytest.mark.parametrize("small", [False, True])
def test_hot_groups_in_blocks(spark, monkeypatch, small):
    """A large family of near copies, a large group of exact ones, and texts that share a passage."""
    if small:
        monkeypatch.setattr(jaccard_join, "BUCKET", 16)
        monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(80)]
    texts = ["all the same text of some more words"] * 30 + [None, "", " \n", "one two", "one two", "one two three"]
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"e{k}{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [" ".join([f"u{k}_{i}" for i in range(30)] + base[:25]) for k in range(20)]
    rows = list(enumerate(texts))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_edge_cases(spark):
    rows = [(None, "a b c d e f g", 0), (4, "a b c d e f g", 0), (4, "a b c d e f g", 0), (2, None, 0), (1, "", 0), (9, "x " * 50_000, 0), (8, "x " * 40_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_links int")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_classes(frame).collect())
    assert got == [("1", "1", 0), ("2", "2", 0), ("4", "None", 2), ("4", "None", 2), ("8", "8", 1), ("9", "8", 1), ("None", "None", 2)]
    assert sorted(str(r.doc_id) for r in one_of_each(frame).collect()) == ["1", "2", "8", "None"]
    assert one_of_each(frame).columns == frame.columns
    assert jaccard_classes(frame.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 90, 90: 90, 95: 90}


def test_prefixes_shorten_to_the_target():
    assert recall_at(prefix_length(), LEAST) >= 0.9999 > recall_at(prefix_length() + 1, LEAST)
    assert prefix_length(0.5) > prefix_length(0.99) > prefix_length(1.0) == 1


def test_paths_sort_as_tries():
    rng = np.random.default_rng(1)
    signature = rng.integers(0, 3, (200, TREES * DEPTH)).astype(np.uint8)
    path, steps = paths(signature), signature.reshape(200, TREES, DEPTH)
    for tree in (0, TREES - 1):
        assert [tuple(steps[k, tree]) for k in np.argsort(path[:, tree], kind="stable")] == sorted(tuple(x) for x in steps[:, tree])
        for length in (1, 4, 8):
            same = prefixes(path[:, tree][:, None], length) == prefixes(path[:, tree][None, :], length)
            assert (same == (steps[:, tree, None, :length] == steps[None, :, tree, :length]).all(axis=2)).all()


def test_shortened_prefixes_link_what_one_short_prefix_links():
    """Families over all depths are those of the shortest prefix alone."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (6, TREES * DEPTH)).astype(np.uint8)
    signature = np.repeat(base, 12, axis=0)
    signature[:, :4] = 7
    change = rng.random(signature.shape) < 0.12
    change[:, :4] = False
    signature = np.where(change, rng.integers(0, 256, signature.shape), signature).astype(np.uint8)
    path, ids = paths(signature)[:, 0], np.arange(len(signature)) * 10
    order = np.argsort(path, kind="stable")
    a, b, _ = (np.array(x) for x in trie_links(np.zeros(len(ids), np.int64), path[order], ids[order], signature[order], 4))
    root = dict.fromkeys(ids.tolist())
    joined = {x: {x} for x in root}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        both = joined[x] | joined[y]
        joined.update(dict.fromkeys(both, both))
    alike = {x: {x} for x in root}
    for i, j in combinations(range(len(ids)), 2):
        if (signature[i] == signature[j]).mean() >= jaccard_join.ALIKE:
            both = alike[ids[i]] | alike[ids[j]]
            alike.update(dict.fromkeys(both, both))
    assert {x: frozenset(joined[x]) for x in root} == {x: frozenset(alike[x]) for x in root}
    assert len(a) == len(ids) - len({frozenset(x) for x in joined.values()})


def test_recall_on_exact_links_of_whole_texts(spark, sf_dir):
    """All links of a fixed fifth of the documents, by all pairs, are found."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if hash((r.doc_id * 2654435761) % 5) == 0]
    got = jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if grams(dict(docs)[r.doc_id])) == [x for x in brute(docs) if grams(dict(docs)[x[0]])]


def test_one_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "m"), (2, "a b c d e f", "a"), (3, None, None), (3, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text, str(r.source)) for r in one_of_each(frame).collect()) == [(1, "a b c d e f", "m"), (3, None, "None")]


def test_lone_pairs_beside_many_close_links(spark):
    """Pairs of likeness 0.8 that share no prefix of 7 steps in any trie, beside 150 pairs of likeness 0.95."""

    def pairs(name, count, at):
        words = [[f"{name}{k}_{i}" for i in range(40)] for k in range(count)]
        return [[" ".join(w), " ".join([*w[:at], "other", *w[at + 1 :]])] for w in words]

    lone = pairs("lone", 3000, 36)
    keys = [prefixes(paths(signatures(*shingles(data, at))), 7) for _, _, data, at in slices(pa.array(sum(lone, [])))]
    shared = np.concatenate(keys).reshape(len(lone), 2, -1)
    hard = [p for p, k in zip(lone, shared, strict=True) if not (k[0] == k[1]).any()]
    assert len(hard) > 10
    rows = list(enumerate(sum(hard + pairs("close", 150, 39), [])))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)
