"""Words of UTF-8 texts as 64-bit hashes, computed with numpy on Arrow's own buffers.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, all of which are ASCII, so working on bytes is exact
for UTF-8. Texts are walked in blocks that end between words: memory is bounded however long a text is.
"""
from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Arrays from so many bytes on are mapped one by one, so the machine has them back as soon as they are freed.
_MAPPED, _M_MMAP_THRESHOLD = 1 << 20, -3
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK + 1, 1 << (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, dtype=np.uint64)
            q = np.full(size, _INVERSE, dtype=np.uint64)
            p[0] = q[0] = 1
            _powers[size] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[size]


def _map_large_arrays() -> None:
    """Fix the C library's limit (where it has one), which otherwise rises with use and lets a reused worker keep its peak."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option is not None:
        set_option(_M_MMAP_THRESHOLD, _MAPPED)


_map_large_arrays()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    if offs is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a text's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = inner[inner > 0] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = _power_tables(len(data))
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=run[1:])
        h = (run[ends] - run[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for every text where its words begin (len(texts) + 1 numbers)."""
    starts, ends = spans(data, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # blocks of words that span about _BLOCK bytes
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        a, b = starts[i], ends[j - 1]
        block = data[a:b]
        out[i:j] = _hash_block(_LOWER[block] if lower else block, starts[i:j] - a, ends[i:j] - a)
        i = j
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words: entry i covers words i to i + n - 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n <= 8:
        with np.errstate(over="ignore"):
            h = words[:m].copy()
            for k in range(1, n):
                h = mix(h) + words[k : k + m] * np.uint64(0xA24BAED4963EE407)
            return mix(h + np.uint64(n))
    p, q = _power_tables(len(words))
    with np.errstate(over="ignore"):
        run = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * p[: len(words)], out=run[1:])
        return mix((run[n:] - run[:m]) * q[:m] + np.uint64(n))


def slices(texts: pa.Array, limit: int = 1 << 20, rows: int = 1 << 16):
    """Cut an array of texts into runs of about ``limit`` bytes and at most ``rows`` texts: (first row, end, bytes, offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offs = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, i + rows)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    pa.default_memory_pool().release_unused()
