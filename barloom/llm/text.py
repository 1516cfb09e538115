"""Batch text kernels: words, hashes and n-grams of many documents at once in numpy.

Texts arrive as Arrow string arrays; a batch is worked through in pieces of bounded size, so memory
does not depend on how Spark cuts its batches. A longer document is a piece of its own; its words are hashed
in chunks, so that what it needs beyond its own bytes is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE + (PIECE >> 2))
            inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
            steps = np.full(n, _MUL, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most that many bytes together, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of [^\\x20\\x09-\\x0D], and each document's first word (n+1 values)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = SPACE[buf]
    filled = offsets[1:] > offsets[:-1]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[offsets[:-1][filled]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[offsets[1:][filled] - 1] = True
    solid = ~gap
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(starts: np.ndarray, ends: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of words whose bytes span at most that many, at least one word each."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield i, j
        i = j


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased; equal words hash alike wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    for i, j in chunks(starts, ends):
        a, b = starts[i], ends[j - 1]
        up, down = _POWERS.need(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[LOWER[buf[a:b]]] * up[: b - a], out=sums[1:])
        h = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word shingles (repeats kept) and their n+1 offsets.

    A document with fewer words than the width, but with some, has its whole sequence as one shingle.
    """
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offs = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(count)), per)
    at = first[doc] + (np.arange(offs[-1]) - offs[doc])
    length = np.minimum(count[doc], width)
    acc = length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(width):
        inside = k < length
        value = h[np.where(inside, at + k, 0)] if len(h) else np.zeros(0, np.uint64)
        acc = np.where(inside, mix(acc * np.uint64(0x9FB21C651E98DF25) + value), acc)
    return acc, offs
