"""Array helpers for text columns inside Arrow tasks.

A text column is handled as one flat UTF-8 byte buffer with row offsets, and
worked on in blocks of rows of a bounded number of bytes, so that a task's
memory does not depend on the number of rows in an Arrow batch.  One text
longer than the bound is a block of its own.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x = x ^ (x >> U64(33))
    x = x * _MIX2
    return x ^ (x >> U64(33))


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row has no bytes."""
    col = column.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows with at most ``limit`` bytes each (or one row)."""
    _, offsets = flat_utf8(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def free_name(name: str, taken) -> str:
    """``name``, lengthened until no column has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def byte_set(pattern_ranges) -> np.ndarray:
    """Boolean table over bytes from inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in pattern_ranges:
        t[lo:hi + 1] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts, ends and row of the maximal runs of word bytes; a run ends at
    the end of its row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base and of its inverse modulo 2**64."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 64)
        inv = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inv)):
            p = np.full(size, U64(base), U64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["p"], _POW["i"]


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes, mixed with its length: for
    hashed features.  Regular words collide modulo a power of two; ``word_keys``
    tells words apart."""
    if not len(starts):
        return np.zeros(0, U64)
    p, inv = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * p[:len(data)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix64(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


_KEYS_AT = 1 << 16
_KEYS = mix64(np.arange(1, _KEYS_AT + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def _position_keys(at: np.ndarray) -> np.ndarray:
    """A random odd multiplier for every place in a word."""
    if not len(at) or int(at.max()) < _KEYS_AT:
        return _KEYS[at]
    return mix64((at.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F)) | U64(1)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of spans of bytes.  Up to 7 bytes: the bytes themselves and
    the length, so different short words have different keys.  Longer ones: a
    sum of byte values times independent multipliers per place (no power of one
    base, so regular words do not collide), marked in the top bit."""
    n = (ends - starts).astype(np.int64)
    out = n.astype(U64) << U64(56)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    few = np.minimum(n, 7)
    for k in range(7):
        out |= np.where(few > k, padded[starts + k], 0).astype(U64) << U64(8 * k)
    long = np.flatnonzero(n > 7)
    size = np.cumsum(n[long])
    i = 0
    while i < len(long):  # a bounded number of bytes at a time
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK_BYTES, "right")))
        own = long[i:j]
        m = n[own]
        if j == i + 1 and m[0] > BLOCK_BYTES:
            total = U64(0)
            for a in range(0, int(m[0]), BLOCK_BYTES):
                b = min(int(m[0]), a + BLOCK_BYTES)
                part = data[starts[own[0]] + a:starts[own[0]] + b]
                total = total + (_position_keys(np.arange(a, b)) * _BYTE_VALUE[part]).sum(dtype=U64)
            sums = np.array([total], U64)
        else:
            rel = ragged(np.zeros(len(own), np.int64), m)
            term = _position_keys(rel) * _BYTE_VALUE[data[rel + np.repeat(starts[own], m)]]
            sums = np.add.reduceat(term, np.cumsum(m) - m)
        out[own] = mix64(sums + m.astype(U64) * U64(0xD6E8FEB86659FD93)) | U64(1 << 63)
        i = j
    return out


def release() -> None:
    """Gives a finished task's memory back to the system: Python workers live on
    and would otherwise keep their peak while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, count), one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts.astype(np.int64) - (np.cumsum(counts) - counts), counts)
    return out + np.arange(total)
