"""Substring dedup against a dictionary of all windows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import substrings, words
from quern.llm.queries import ORACLE_SQL
from quern.llm.substrings import Passages, Words, op2_substring_dedup, substring_dedup
from tests.oracle import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, n=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[s : s + n]) for w in words for s in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s : s + n])] > 1:
                gone.update(range(s, s + n))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_op2_equals_sql(spark, sf_dir):
    assert same_rows(op2_substring_dedup(spark, sf_dir), ORACLE_SQL["op2_substring_dedup"], sf_dir) == 1000


def test_edge_cases(spark):
    run = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"x{k % 9001}" for k in range(60_000))
    texts = [
        None, "", " \t\n ", "a b", run, f"  before {run}\n after", run, "same " * 36, "same " * 35, "other " * 34,
        " ".join(f"w{k}" for k in range(34)), f"é {run[:150]} ü", long, f"{run} {' '.join(f'y{k}' for k in range(40))} {run}",
        " ".join(f"z{k}" for k in range(50)), " ".join(f"z{k}" for k in range(10, 50)),
    ]
    rows = [(None if k == 3 else k, t, 7, "x") for k, t in enumerate(texts)] + [(4, texts[4], 7, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, range string")
    got = substring_dedup(frame)
    assert got.columns == ["doc_id", "text", "range", "n_words", "n_removed"]
    expected = sorted((str(r[0]), *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got.collect()) == expected
    assert substring_dedup(frame.limit(0)).count() == 0


def test_forged_hashes_remove_nothing_unique(spark, monkeypatch):
    """Windows of one first hash are told apart by the second; passages by their words."""
    keys = words.unit_keys
    rough = lambda data, starts, ends: (keys(data, starts, ends)[0] % np.uint64(3), keys(data, starts, ends)[1])
    texts = [" ".join(f"{chr(97 + d)}{k}" for k in range(80)) for d in range(6)]
    texts += [f"{texts[0]} tail", " ".join(reversed(texts[1].split()))]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    monkeypatch.setattr(substrings, "unit_keys", rough)
    held = Words(data, np.array([0, len(data)]), 35, 16)
    assert len(set(held.h.tolist())) <= 3 and len(set(zip(*(x.tolist() for x in held.digests(35)), strict=True))) > 400
    # the operator over rough keys, in this process
    group = pa.table({"text": texts, "_shard": [0] * len(texts)})
    got = in_process(group, monkeypatch)
    assert got == [x[2] for x in brute(texts)]


def in_process(group, monkeypatch):
    """The three steps over one shard without Spark."""
    window, phrase = 35, 16
    parts = [(data, Words(data, at, window, phrase)) for _, _, data, at in substrings.slices(group["text"].combine_chunks())]
    (data, held), = parts
    digests = list(zip(*(x[held.windows].tolist() for x in held.digests(window)), strict=True))
    twice = Counter(digests)
    own = np.array([k for k, x in enumerate(digests) if twice[x] > 1], np.int64)
    at = held.chosen(window, phrase)[own]
    starts = held.windows[own]
    mask = substrings._stretches(len(held.h), starts, window)
    alphabet = substrings.Alphabet(held.h[mask], held.g[mask])
    text = alphabet.spelled(held)
    passages = substrings.Passages(window, phrase, alphabet.width)
    passages.add(text, starts + held.row[starts], at + held.row[at])
    change = np.zeros(len(text) // alphabet.width + 1, np.int32)
    for machine in passages.automata():
        passages.cover(machine, text, change)
    covered = np.cumsum(change[:-1])[np.arange(len(held.h)) + held.row] > 0
    out, bounds = substrings.kept_words(data, held, covered, group.num_rows)
    return [out[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_the_automata_decide(spark, monkeypatch):
    """Without hits nothing goes; several automata of a shard give what one gives."""
    run = " ".join(f"w{k}" for k in range(60))
    group = pa.table({"text": [f"a {run}", f"{run} b", " ".join(f"w{k}" for k in range(5, 45))], "_shard": [0, 0, 0]})
    expected = [x[2] for x in brute(group["text"].to_pylist())]
    assert in_process(group, monkeypatch) == expected
    monkeypatch.setattr(substrings, "AUTOMATON_PHRASES", 1)
    assert in_process(group, monkeypatch) == expected
    monkeypatch.setattr(Passages, "automata", lambda self: iter(()))
    assert in_process(group, monkeypatch) == group["text"].to_pylist()
