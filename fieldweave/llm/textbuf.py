"""Arrow text columns as flat byte arrays for numpy, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd base of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: A random odd value per byte.
BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of rows of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    ends = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i`` below ``n`` at least."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, PIECE_BYTES + 1), U64(base))
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        _powers[base] = found
    return found


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * BASE ** i``; one longer than ``values``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``, alike wherever equal slices stand."""
    return (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of all words, and the first word of each row (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SEPARATOR[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[1:-1][edges]  # a word never runs into the next row
    closes[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    prefix = prefix_hashes(BYTE[_LOWER[data] if lower else data])
    return mix(slice_hashes(prefix, starts, ends)), starts, np.searchsorted(starts, offsets)
