"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  All of it works
on the UTF-8 bytes, so no Python string is made.  Work is done in blocks of about half a MiB of text:
the memory of a task doesn't depend on the length of a batch, and a very long document is cut at
word ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .storage import return_freed_memory

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes, one document at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; a document begin in ``starts`` also ends a word."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


class Words:
    """The words of documents i to j of a buffer: hash, document (from 0), begin and end byte (in the buffer)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, i: int, j: int) -> None:
        lo, hi = int(offs[i]), int(offs[j])
        self.n_docs = j - i
        parts, at = [], lo
        while at < hi or not parts:
            to = hi
            if hi - at > 8 * BLOCK:  # one very long document: cut after a word
                to = at + 8 * BLOCK
                while to < hi and not SPACE[data[to]]:
                    to += 1
            part = data[at:to]
            begin, end = _bounds(part, offs[i : j + 1] - at)
            parts.append((_hashes(part, begin, end), begin + at, end + at))
            at = to
        self.hash, self.begin, self.end = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        self.doc = np.searchsorted(offs[i : j + 1], self.begin, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def each_block(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(first document, its words, the buffer) for each block of a string column."""
    return_freed_memory()
    data, offs = text_buffer(column)
    for i, j in blocks(offs):
        yield i, Words(data, offs, i, j), data


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive elements; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for step in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[step : step + n]
    return mix(out)


def long_grams(h: np.ndarray, k: int) -> np.ndarray:
    """As :func:`grams`, by prefix sums: the time doesn't grow with k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; with fewer words the whole sequence is one shingle."""
    all_grams = grams(words.hash, k)
    out = []
    for d in range(words.n_docs):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(words.hash[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_column(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one array for each row."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
