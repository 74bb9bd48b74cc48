"""Vectorised words and word n-grams over Arrow string columns.

A word is a longest run of bytes other than ASCII white space, after Unicode
lower-casing. Words and n-grams are 64-bit hashes made by numpy over the column's
bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1001, 1001 + 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row's text and the end). Nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: hash, byte span in the batch, and for each row its first word (with an end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array, lower: bool = True) -> Words:
    """Words of each row of a string column."""
    if lower:
        column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    raw, offsets = text_buffer(column)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64), raw, offsets)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64), raw, offsets)
    lens = ends - starts
    inside = raw[solid]
    place = np.arange(len(inside), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    terms = _BYTE[inside] * _PLACE[place & 4095]
    sums = np.add.reduceat(terms, np.cumsum(lens) - lens)
    hashes = mix(sums + lens.astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), raw, offsets)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word n-gram in order; a row of 1 to n - 1 words has one gram of all its words."""
    h, first = w.hashes, w.first
    counts = np.diff(first)
    many = np.maximum(counts - n + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), many)
    if len(rows) == 0:
        return np.zeros(0, np.uint64), rows
    at = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][rows]
    out = np.zeros(len(rows), np.uint64)
    last = first[1:][rows]
    with np.errstate(over="ignore"):
        for k in range(n):
            pos = at + k
            ok = pos < last
            term = np.where(ok, h[np.minimum(pos, len(h) - 1)], np.uint64(0))
            out = out * np.uint64(0x9E3779B97F4A7C15) + term + np.uint64(k + 1)
    return mix(out), rows


def unique_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row; (values, first index of each row with an end)."""
    if len(values) == 0:
        return values, np.zeros(n_rows + 1, np.int64)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


def pieces(column: pa.Array, most: int = 1 << 20):
    """Slices (first row, column) of a column, each of up to `most` bytes or one row."""
    raw, offsets = text_buffer(column)
    k, n = 0, len(offsets) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, column.slice(k, j - k)
        k = j


def release() -> None:
    """Gives freed memory back to the system; a worker process otherwise keeps its peak from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        pass
