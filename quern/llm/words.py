"""Vectorised word spans and word hashes over Arrow string batches (numpy, inside tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.shared import SPACE

#: True for bytes of words that white space separates.
PLAIN = np.ones(256, bool)
PLAIN[list(SPACE.encode())] = False
#: Odd multipliers and shifts of the 64-bit mixing.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FLIP = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes up to which keys are made by blocks of eight; longer spans are digested one by one.
LONG = 256
#: Powers that a Python worker keeps; longer texts make their own.
_KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0..n-1 of ``base``, modulo 2^64."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        found = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16) - 1, base)]), dtype=np.uint64)
        if n <= _KEPT_POWERS:
            _powers[int(base)] = found
    return found[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the bounds of its rows; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive rows of about ``most`` bytes; a longer text stands alone."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more at the end)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = inside[data]
    before, after = word[:-2].copy(), word[2:].copy()
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(word[1:-1] & ~before)
    ends = np.flatnonzero(word[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def unit_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each span's bytes, from blocks of eight; together they stand for it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_every_byte = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = (ends - starts).astype(np.int64)
    n = left.astype(np.uint64)
    a, b = mixed(n * _BASE + _FLIP), n * _FLIP
    own, at, long = np.arange(len(starts)), starts, left > LONG
    if long.any():
        own, at, left = own[~long], at[~long], left[~long]
    while len(own):
        block = at_every_byte[at]
        tail = left < 8
        block[tail] &= (np.uint64(1) << (left[tail].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        a[own] = mixed(a[own] * _BASE + block)
        b[own] = (b[own] ^ block) * _FLIP
        b[own] ^= b[own] >> np.uint64(29)
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(long).tolist():
        a[k], b[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest(), "<u8")
    return a, b


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return unit_keys(data, starts, ends)[0]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes (rows' bounds are the caller's): differences of one running sum."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(_BASE, len(h)), dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * _power(_INVERSE, len(h))[: len(h) - n + 1])
