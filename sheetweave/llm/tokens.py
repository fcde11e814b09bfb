"""Vectorised word hashing over Arrow string batches.

Everything here runs inside Spark tasks on one batch at a time.  A word is a
maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # a worker that stays gives memory back after a batch

#: Bytes of text that are hashed at once, which bounds a task's memory.
CHUNKBYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


BYTE = seeds(256, 11)
_ODD = seeds(4, 23) | np.uint64(1)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[0] = 0; the bytes [i, j) hash to (c[j] - c[i]) * down[i]."""
    up, _ = Powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNKBYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their bytes and offsets, at most ``limit`` bytes unless one text alone is longer."""
    data, at = text_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the range of its words; ``space`` marks the bytes that part words."""
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[-1] = True
    gap = space[data]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | cut[1:-1]
    last[:-1] &= gap[1:] | cut[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each text the range of its words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    start, end, of = word_bounds(data, at, space)
    sums = prefix_hashes(LOWER[data])
    _, down = Powers.upto(len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start]), of


def shingles(data: np.ndarray, at: np.ndarray, width: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's sorted distinct shingle hashes and its number of words.

    A text of fewer than ``width`` words has its whole sequence as one shingle,
    one without words has none.
    """
    words, of = word_hashes(data, at)
    many = np.diff(of)
    factor = seeds(width, 31) | np.uint64(1)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * factor[j]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(many):
        if n >= width:
            out.append(np.unique(rolled[of[i] : of[i + 1] - width + 1]))
        elif n:
            out.append(mix((words[of[i] : of[i + 1]] * factor[:n]).sum(dtype=np.uint64, keepdims=True) + factor[n - 1 : n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, many
