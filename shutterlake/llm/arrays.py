"""Texts of an Arrow batch as flat numpy arrays: words, hashes, runs.

Everything here works on a slice of a batch at once, so the cost per word is a
few array operations and no Python object is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_factors(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random odd 64-bit factors, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class _Factors:
    """Factors by position, grown to the longest word seen."""

    def __init__(self, seed: int):
        self.seed, self.have = seed, odd_factors(256, seed)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.have):
            self.have = odd_factors(2 * n, self.seed)
        return self.have


_BY_PLACE = _Factors(11)
_BYTE = odd_factors(256, 5)
_BYTE[_WHITE] = 0


def texts(column: pa.Array) -> pa.Array:
    """Text column without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets from 0."""
    return flat_binary(texts(column))


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` for a binary (or text) column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each row the
    index of its first word (n + 1 entries)."""
    solid = ~_WHITE[data]
    begin, end = solid.copy(), solid.copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    place = np.minimum(place, int((ends - starts).max()), out=place)
    values = _BYTE[data]
    values *= _BY_PLACE.upto(int(place.max()) + 1)[place]
    sums = np.add.reduceat(values, starts)
    return mix(sums + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def binary(flat_bytes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column over a flat byte array."""
    if len(flat_bytes) >= 2**31 - 1:
        raise ValueError("a slice's binary column exceeds 2 GB")
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat_bytes))]
    )


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
