"""Array kernels over the UTF-8 buffers of Arrow columns: words, fingerprints and packed rows, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; texts are never cut, a longer one just makes a longer piece.
PIECE = 2 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: As BYTES, with A-Z read as a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    return _powers(1 << max(21, int(size).bit_length()))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of any run of values follows: see run_prints()."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def run_prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end], the same wherever a run of equal values stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    rows = len(column)
    if not rows:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than [\\x20\\x09-\\x0D], and each row's bounds among them."""
    space = SPACE[data]
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    start[at] = ~space[at]
    at = offsets[1:][filled] - 1
    end[at] = ~space[at]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_values: np.ndarray = BYTES) -> np.ndarray:
    """64-bit fingerprints of the bytes in each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        sums = prefix_sums(byte_values[data[base : ends[j - 1]]])
        out[i:j] = run_prints(sums, starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that what compresses shuffle blocks finds runs of equal high bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
