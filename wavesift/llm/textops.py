"""Array kernels over the UTF-8 bytes of Arrow string columns.

Every operator on texts runs these inside ``mapInArrow``: a batch is cut into
slices of about ``SLICE_BYTES`` so that memory stays bounded by the slice (or by
one very long document), and all work inside a slice is vectorised.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes never
occur inside a multi-byte UTF-8 sequence, so working on bytes equals working on
characters. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_MULT = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        m = _MULT[seed]
        tables = []
        for base in (m, pow(m, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _POWERS[seed] = (tables[0], tables[1])
    return have


def forget() -> None:
    """Drop tables of powers that a very long text has left."""
    for seed in [s for s, (up, _) in _POWERS.items() if len(up) > 1 << 20]:
        del _POWERS[seed]


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Mixed polynomial hash of ``codes[start:end]`` for many spans at once."""
    n = len(codes)
    up, down = _powers(n + 1, seed)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def run_hash(codes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``codes[i:i+k]``; empty when there are fewer than k codes."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1, seed)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[:n], out=total[1:])
    out = total[k:] - total[:-k]
    out *= down[: n - k + 1]
    return mix(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most max_bytes of text; a longer row stands alone."""
    _, off = utf8(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


class Words(NamedTuple):
    """Words of some documents: byte spans, document of each, first word of each document."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    space = _SPACE[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        inner = offsets[1:-1]
        before[inner[inner < n]] = True
        after[inner[inner > 0] - 1] = True
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def word_hash(w: Words, lower: bool = False) -> np.ndarray:
    data = _LOWER[w.data] if lower else w.data
    return span_hash(_BYTE_CODE[data], w.start, w.end)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def in_doc(first: np.ndarray, k: int) -> np.ndarray:
    """Indices i whose k items i..i+k-1 lie in one document; first: n+1 offsets."""
    starts = np.arange(first[-1], dtype=np.int64)
    end = np.repeat(first[1:], np.diff(first))
    return starts[starts + k <= end]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least of every ``values[i:i+width]``, by the top 40 bits.

    The order depends on the values alone, so equal windows anywhere choose the
    same relative position. Chunks bound the positions to 24 bits.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    chunk = 1 << 23
    out = np.empty(n, np.int64)
    for at in range(0, n, chunk):
        part = values[at : at + chunk + width - 1]
        key = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        out[at : at + len(key)] = (key & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over n items: inside ``[s, s+width)`` for some s."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def strings(data: np.ndarray, offsets: np.ndarray, valid: bool = True) -> pa.Array:
    """A string column from bytes and offsets, without a copy through Python."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(pa.binary()).cast(pa.string(), safe=True) if valid else out.cast(pa.binary())
