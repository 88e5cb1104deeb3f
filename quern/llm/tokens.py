"""Token ids of whole texts, in tasks; the vocabularies are files whose path is a parameter.

A text is cut where no token can cross, its units are told apart by 128-bit keys, and each distinct unit of a Python
worker is encoded once by the tokenizers library. Texts that hold a special token, or white space that can't be cut so,
are encoded whole.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.words import slices, unit_keys

#: Units that a Python worker keeps between batches; those that came first, the common ones, outlast the others.
CACHED_UNITS = 1_000_000
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: The class of each byte: white space, ASCII letters, digits and signs, and what only the library may cut.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_CLASS[[b for b in range(33, 127) if b != ord("'")]] = _SIGN
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = _DIGIT
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Stands between ASCII units that are encoded together.
_MARK = "\u0100"
#: White space beyond ASCII.
_WIDE_SPACE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


class _Kept:
    """What a Python worker keeps of one vocabulary: the ids of units, one after the other."""

    def __init__(self) -> None:
        self.index: dict[int, int] = {}
        self.halved = False  # whether the last addition put others out
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray]) -> None:
        self.halved = len(self.key) + len(key) > CACHED_UNITS
        if self.halved:
            half = min(len(self.key), CACHED_UNITS // 2)
            self.key, self.check, self.bounds = self.key[:half], self.check[:half], self.bounds[: half + 1]
            self.ids = self.ids[: self.bounds[-1]]
            self.index = dict(zip(self.key.tolist(), range(half), strict=True))
        first = len(self.key)
        self.index.update(zip(key.tolist(), range(first, first + len(key)), strict=True))
        self.key, self.check = np.concatenate([self.key, key]), np.concatenate([self.check, check])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, *ids]) if ids else self.ids


_kept: dict[str, _Kept] = {}


class Encoder:
    """Ids of a column of texts: ``encoder(column)`` gives all ids and the bounds of its rows; null is empty.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        self.path = path

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, whether the unit is of one class of ASCII) of what can be encoded alone."""
        raise NotImplementedError

    def encode_units(self, units: list[str], plain: np.ndarray) -> list[np.ndarray]:
        raise NotImplementedError

    def whole_rows(self, column: pa.Array) -> np.ndarray:
        """Rows that must be encoded whole."""
        found = np.zeros(len(column), bool)
        for x in _special(self.path):
            found |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        return found

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column, "")
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for i, j, data, at in slices(column):
            ids, n = self._slice(column.slice(i, j - i), data, at)
            out.append(ids)
            sizes.append(n)
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))

    def _slice(self, column: pa.Array, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, plain = self.units(data, at)
        key, check = unit_keys(data, starts, ends)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        row = np.searchsorted(at, starts, "right") - 1
        whole = self.whole_rows(column)
        whole[row[check != check[first][which]]] = True  # different units of one key
        known = _kept.setdefault(self.path, _Kept())
        place = np.fromiter(map(known.index.get, distinct.tolist(), [-1] * len(distinct)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            raw = data.tobytes()
            encoded = self.encode_units([raw[a:b].decode() for a, b in spans], plain[first[new]])
            known.add(distinct[new], check[first[new]], encoded)
            place = np.fromiter(map(known.index.get, distinct.tolist(), [-1] * len(distinct)), np.int64, len(distinct)) if known.halved else place
            place[new] = np.arange(len(known.key) - len(new), len(known.key))
            if (place < 0).any():  # what this slice needs was put out just now
                whole[row[(place < 0)[which]]] = True
        bad = known.check[np.maximum(place, 0)] != check[first]
        whole[row[bad[which]]] = True
        n = (known.bounds[place + 1] - known.bounds[place])[which]
        keep = ~whole[row]
        n, begin = n[keep], known.bounds[place[which[keep]]]
        ends_at = np.cumsum(n)
        ids = known.ids[np.arange(int(n.sum())) + np.repeat(begin - ends_at + n, n)]
        sizes = np.bincount(row[keep], n, len(at) - 1).astype(np.int64)
        if whole.any():
            return self._with_whole(column, ids, sizes, np.flatnonzero(whole).tolist())
        return ids, sizes

    def _with_whole(self, column: pa.Array, ids: np.ndarray, sizes: np.ndarray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in rows:
            parts[k] = np.array(_tokenizer(self.path).encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
            sizes[k] = len(parts[k])
        return np.concatenate(parts), sizes


def _ids_by_mark(tokenizer, words: list[str], between: str, mark: int, at_once: int) -> list[np.ndarray | None]:
    """The ids of each word, encoded many at once with a mark between; None where marks don't tell words apart."""
    parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
    out: list[np.ndarray | None] = []
    for part, e in zip(parts, tokenizer.encode_batch_fast([between.join(x) for x in parts], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        cuts = np.flatnonzero(ids == mark).tolist()
        out += [ids[a + 1 : b] for a, b in pairwise([-1, *cuts, len(ids)])] if len(cuts) == len(part) - 1 else [None] * len(part)
    return out


def _each(tokenizer, units: list[str], found: list[np.ndarray | None]) -> list[np.ndarray]:
    """``found``, with each missing one encoded by itself."""
    rest = [k for k, x in enumerate(found) if x is None]
    for k, e in zip(rest, tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
        found[k] = np.array(e.ids, np.uint32)
    return found


def _classes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, starts and ends of runs without white space, whether each is all of letters, digits and signs)."""
    kind = _CLASS[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind != _SPACE
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    begins[at[:-1][at[:-1] < len(data)]] = inside[at[:-1][at[:-1] < len(data)]]
    ends = inside[:-1] & ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    return kind, starts, stops, other[starts] == other[stops]


class WordEncoder(Encoder):
    """A lower-casing vocabulary of word pieces that drops white space; digits stand alone, letters and signs in runs."""

    @staticmethod
    @cache
    def _plain(path: str):
        """The vocabulary without the steps that change no lower-case ASCII unit, and the id of a character of no such unit."""
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        found = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        (mark,) = found.encode(_MARK, add_special_tokens=False).ids
        return found, mark

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kind, starts, stops, fine = _classes(data, at)
        size = stops - starts
        cut = np.zeros(len(data) + 1, bool)
        plain = np.zeros(len(data), bool)
        plain[kind != _SPACE] = np.repeat(fine, size)
        cut[1:-1] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        cut[starts] = True
        begins = np.flatnonzero(cut)
        # a unit ends at the next one's start or where its run ends
        run = np.searchsorted(starts, begins, "right") - 1
        ends = np.minimum(np.concatenate([begins[1:], [len(data)]]), stops[run]) if len(begins) else begins
        return np.where(plain, _LOWER[data], data), begins, ends, fine[run]

    def encode_units(self, units: list[str], plain: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(units)
        for which, encode in ((np.flatnonzero(plain), self._plain_ids), (np.flatnonzero(~plain), self._other_ids)):
            for k, ids in zip(which.tolist(), encode([units[k] for k in which.tolist()]), strict=True):
                out[k] = ids
        return out

    def _plain_ids(self, units: list[str]) -> list[np.ndarray]:
        tokenizer, mark = self._plain(self.path)
        return _ids_by_mark(tokenizer, units, f" {_MARK} ", mark, 256)

    def _other_ids(self, units: list[str]) -> list[np.ndarray]:
        tokenizer = _tokenizer(self.path)
        (mark,) = tokenizer.encode("\x01", add_special_tokens=False).ids
        return _each(tokenizer, units, _ids_by_mark(tokenizer, units, " \x01 ", mark, 64))


class ByteEncoder(Encoder):
    """A byte-level vocabulary: a word takes one space before it along, other white space stands in runs."""

    def whole_rows(self, column: pa.Array) -> np.ndarray:
        found = super().whole_rows(column)
        if pc.any(pc.match_substring_regex(column, f"[{_WIDE_SPACE}]")).as_py():
            near = f"[{_WIDE_SPACE}][ \\t\\n\\x0b\\x0c\\r]|[ \\t\\n\\x0b\\x0c\\r][{_WIDE_SPACE}]"
            found |= pc.match_substring_regex(column, near).to_numpy(zero_copy_only=False)
        return found

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kind, starts, stops, fine = _classes(data, at)
        size = stops - starts
        plain = np.zeros(len(data), bool)
        plain[kind != _SPACE] = np.repeat(fine, size)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True  # rows
        cut = edge[:-1].copy()
        space = kind == _SPACE
        cut[1:] |= space[1:] & ~space[:-1]  # where white space begins
        cut[1:] |= plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])
        # the last of a run of white space before a word stands with it if it is a space, else alone
        before = starts[(starts > 0) & ~edge[starts]] - 1
        before = before[space[before]]
        cut[before] = True
        alone = before[data[before] != 32]
        cut[alone + 1] = True
        begins = np.flatnonzero(cut)
        ends = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
        return data, begins, ends, np.zeros(len(begins), bool)

    def encode_units(self, units: list[str], plain: np.ndarray) -> list[np.ndarray]:
        tokenizer = _tokenizer(self.path)
        (mark,) = tokenizer.encode("\n", add_special_tokens=False).ids
        out: list = [None] * len(units)
        # behind a line feed a unit keeps its ids if it has no white space but for a first space
        joined = [k for k, x in enumerate(units) if x != " " and not any(map(str.isspace, x[1:])) and (x[0] == " " or not x[0].isspace())]
        for k, ids in zip(joined, _ids_by_mark(tokenizer, [units[k] for k in joined], "\n", mark, 128), strict=True):
            out[k] = ids
        return _each(tokenizer, units, out)
