"""Texts of an Arrow batch as byte arrays: words, hashes and windows for all documents of a slice at once.

Hashes are polynomials modulo 2**64 over random 64-bit values of the bytes, mixed at the end. A slice holds whole documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1_000_000
#: Documents that are worked on at once.
SLICE_DOCS = 1_000

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bytes(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = word_bytes(bytes([0x20, *range(0x09, 0x0E)]))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased bytes)
LETTERS = word_bytes(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins, the end of the last one included; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(first + SLICE_DOCS, max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1))
        yield first, last
        first = last


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, the one after the last, their bytes, bounds from 0) of each slice."""
    data, bounds = utf8(column)
    for i, j in slices(bounds, most):
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, n)[:n], out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of [first, last), element by element; equal contents have equal hashes wherever they stand."""
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64) * VALUES[0])


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of each word; no word crosses a document's bounds."""
    inside = table[data]
    new = np.zeros(len(data) + 1, dtype=bool)
    new[bounds] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    now = np.zeros(len(data) + 1, dtype=bool)
    now[:-1] = inside
    begin = np.flatnonzero(now & (~before | new))
    end = np.flatnonzero(before & (~now | new))
    return begin, end, np.searchsorted(bounds, begin, "right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(VALUES[data]).of(begin, end)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place that has k."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 12:
        first = np.arange(n)
        return Rolling(values).of(first, first + k)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= BASE
        out += values[i : i + n]
    return mix(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its first least value."""
    v, at, have = values, np.arange(len(values), dtype=np.int64), 1
    while have < width:
        d = min(have, width - have)
        right = v[d:] < v[:-d]
        v, at, have = np.where(right, v[d:], v[:-d]), np.where(right, at[d:], at[:-d]), have + d
    return at


def anchors(values: np.ndarray, doc_bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined anchors of all windows of `window` values.

    Each window belongs to the first least hash among its k-grams, so equal windows belong to equal anchors at equal offsets, wherever
    they stand. Returns for each anchor: its place, the first and the last start of its windows (an unbroken range), the k-gram's hash.
    Memory is a few arrays of the length of values.
    """
    if len(values) < window:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    hashes = grams(values, k)
    at = least(hashes, window - k + 1)
    lengths = np.diff(doc_bounds)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(doc[: len(at)] == doc[window - 1 :])
    if not len(starts):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    place = at[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], starts[first], starts[last], hashes[place[first]]


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by document."""
    return np.bincount(doc, weights=values, minlength=n)


def distinct_pairs(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, value) pairs in order, and how often each occurs."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return d[at], v[at], np.diff(np.append(at, len(d)))


def covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Places inside any of the ranges [first, last)."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, np.minimum(first, size), 1)
    np.add.at(steps, np.minimum(last, size), -1)
    return np.cumsum(steps[:-1]) > 0
