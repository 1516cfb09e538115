"""Inverted lists of a shard of documents, as flat numpy arrays (CSR): terms, where their lists end, lists.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.
They are told apart by 64-bit hashes: a thousand query terms meet a false one among a hundred million
distinct terms with a probability of 5e-9. A shard is what one Arrow batch holds, cut to SHARD bytes of text
and MOST_DOCS documents; a longer document is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from barloom.llm.text import buffers, pieces, word_hashes, words

SHARD = 4 << 20
MOST_DOCS = 1 << 16

#: What is no part of a term becomes a space; A-Z become a-z.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = 0x20
_PLAIN[65:91] = np.arange(97, 123)


def shards(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, first) of each shard: documents i to j of the batch, their terms' hashes one after
    another, and each document's first term (j - i + 1 values). Null counts as empty."""
    buf, offsets = buffers(column)
    for a, b in pieces(offsets, SHARD):
        for i in range(a, b, MOST_DOCS):
            j = min(i + MOST_DOCS, b)
            plain = _PLAIN[buf[offsets[i] : offsets[j]]]
            starts, ends, first = words(plain, offsets[i : j + 1] - offsets[i])
            yield i, j, word_hashes(plain, starts, ends), first


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """The number of terms of each document, shard after shard; no hashes are made."""
    buf, offsets = buffers(column)
    for i, j in pieces(offsets, SHARD):
        yield np.diff(words(_PLAIN[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])[2])


def invert(hashes: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms ascending, end of each term's list, lists) of (hash, place) pairs, places below span, each list ascending."""
    terms, which = np.unique(hashes, return_inverse=True)
    key = which.astype(np.int64) * span + place
    key.sort()
    return terms, np.cumsum(np.bincount(which, minlength=len(terms))), key % span


def find(terms: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each wanted term's list; a term that is not there has an empty one."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    there = terms[at] == wanted
    upto = ends[at]
    return np.where(there, np.where(at > 0, ends[at - 1], 0), 0), np.where(there, upto, 0)
