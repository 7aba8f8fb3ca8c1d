"""Vectorised scanning of Arrow text columns.

A *block* is a run of consecutive texts laid end to end as one ``uint8``
array.  Blocks hold about ``BLOCK_BYTES`` bytes (or one longer text), so the
memory a task needs does not depend on the size of an Arrow batch.

Words are maximal runs of bytes other than space and 0x09-0x0D.  In UTF-8
those bytes never occur inside a multi-byte character, so splitting bytes is
the same as splitting code points.

Hashes are 64-bit.  A word's hash is a polynomial over its bytes (read off a
prefix sum, so the cost does not depend on word length) that is mixed with the
word's length; equal words have equal hashes, and two given different words
collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BLOCK_BYTES = 1 << 18
NULL_ID = -(1 << 63)  # stands for a null id where a column has to be without nulls
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_DELIM = np.zeros(256, bool)
_DELIM[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _byte_values(seed: int = 0x5EED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets from 0) of each block."""
    data, offsets = text_arrays(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the offsets."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and first word of each document (n + 1)."""
    starts, ends = runs(~_DELIM[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    values = _byte_values()[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of the data behind ``prefix``."""
    _, down = _POWERS.upto(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(h ^ mix((ends - starts).astype(np.uint64)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and first word of each document (n + 1)."""
    starts, ends, first = words(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), first


def ngram_hashes(h: np.ndarray, first: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, and first n-gram of each document (n + 1).

    ``short``: a document with 1 to n - 1 words gives its whole word sequence
    as one gram; otherwise it gives none.
    """
    counts = np.diff(first)
    grams = np.maximum(counts - (n - 1), 0)
    begin = np.concatenate(([0], np.cumsum(grams)))
    with np.errstate(over="ignore"):
        steps = [np.uint64(pow(_BASE, i + 1, 1 << 64)) for i in range(n)]
        position = np.repeat(first[:-1] - begin[:-1], grams) + np.arange(begin[-1])
        total = np.zeros(len(position), np.uint64)
        for i, step in enumerate(steps):
            total += h[position + i] * step
        full = mix(total)
        if not short:
            return full, begin
        few = np.flatnonzero((counts > 0) & (counts < n))
        if not len(few):
            return full, begin
        part = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            has = counts[few] > i
            part[has] += h[first[few][has] + i] * steps[i]
        part = mix(part + counts[few].astype(np.uint64))
    at = begin[few]
    grams[few] = 1
    return np.insert(full, at, part), np.concatenate(([0], np.cumsum(grams)))


def distinct_per_doc(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and where each document begins."""
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, docs))
    v, d = values[order], docs[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(len(first)))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets (n + 1)."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def packed_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the text compressed, for joins that have to move it."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [press.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(NULL_ID), pa.array(texts, pa.binary())], ["doc", "packed"])
