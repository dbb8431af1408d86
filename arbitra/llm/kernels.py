"""Vectorised text kernels over Arrow string buffers.

All of them see a column as one byte buffer with offsets, cut into runs of
whole rows of about ``CHUNK`` bytes, so that the memory in use is a small
multiple of the chunk (or of the longest single text) whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(raw: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about ``most`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class WordHasher:
    """64-bit hashes of the words of each text; a word is a run of bytes in ``word``."""

    def __init__(self, word: np.ndarray, lower: bool = True) -> None:
        self.word = word.astype(np.uint8).tobytes()
        table = np.arange(256, dtype=np.uint64)
        if lower:
            table[65:91] += U64(32)
        with np.errstate(over="ignore"):
            self.value = mix(table + U64(1))
        self.power = np.ones(1, U64)
        self.inverse = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << max(20, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]))
                self.inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE_INVERSE, U64)]))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of the first word of each row and the end)."""
        h, starts = self.hashes(data, offsets)
        return h, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, byte where it starts)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        starts, ends = self.spans(data, offsets)
        self._powers(n)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(self.value[data] * self.power[:n], out=total[1:])
            h = mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(U64))
        return h, starts

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end; no word crosses a row."""
        n = len(data)
        w = np.frombuffer(data.tobytes().translate(self.word), bool)
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = w[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = w[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def space_separated() -> np.ndarray:
    """Words are runs of anything but blank and the control characters 9 to 13."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alphanumeric() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of bytes above 127."""
    t = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = True
    return t


_PLACES = stream(5, 64) | U64(1)


def ngrams(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """For each start, a hash of the items at the given distances from it."""
    span = places[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in places:
            out += h[k : k + n] * _PLACES[k]
        return mix(out)


def shingle_sets(h: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``size`` words of each row, sorted, with offsets.

    A row of fewer words has its whole sequence as its one shingle, a row without
    words has none.
    """
    grams = ngrams(h, tuple(range(size)))
    parts, counts = [], np.zeros(len(rows) - 1, np.int64)
    for i in range(len(rows) - 1):
        a, b = int(rows[i]), int(rows[i + 1])
        if b - a >= size:
            u = np.unique(grams[a : b - size + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                u = mix(np.array([(h[a:b] * _PLACES[: b - a]).sum() + U64(0xA5A5 + b - a)], U64))
        else:
            continue
        parts.append(u)
        counts[i] = len(u)
    offsets = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), offsets


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a contiguous 2-D array as a binary column."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])
