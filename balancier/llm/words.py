"""Words of whole Arrow columns as numpy arrays: places and 64-bit hashes, without a loop over rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Space, tab, newline, vertical tab, form feed, carriage return: what parts words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32

BYTE = np.random.default_rng(20_240_101).integers(0, 2**64, 256, "u8", endpoint=False)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words hashed at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all rows
    offsets: np.ndarray  # of each row in data, one more than rows
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # number of the first word of each row, one more than rows
    hash: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], "i4", len(column) + 1, 4 * column.offset).astype("i8") if len(column) else np.zeros(1, "i8")
    data = column.buffers()[2]
    data = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, "u1")
    return data, offsets - offsets[0]


def split(column: pa.Array, lower: bool = False) -> Words:
    """Words of every row: runs of bytes other than the separators, of A-Z made small if asked."""
    data, offsets = raw(column)
    return split_bytes(LOWER[data] if lower else data, offsets)


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(start), "u8")
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
        a, b = start[at], end[stop - 1]
        heads = start[at:stop] - a
        own = inside[a:b]
        place = np.arange(b - a) - np.repeat(heads, np.diff(np.append(heads, b - a)))
        values = np.where(own, BYTE[data[a:b]] * mix(place.astype("u8") + _STEP), np.uint64(0))
        hashes[at:stop] = np.add.reduceat(values, heads)
        at = stop
    hashes = mix(hashes + (end - start).astype("u8") * _STEP)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashes)


def rolling(values: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each ``n`` values that follow each other; entry ``i`` covers ``values[i : i + n]``."""
    if len(values) < n:
        return np.zeros(0, "u8")
    power, size, covered, rest, block, total = factor, 1, 0, n, values, None
    while rest:
        if rest & 1:
            part = block[: len(values) - size + 1]
            if total is None:
                total = part
            else:  # the part stands before what is covered so far
                m = len(values) - size - covered + 1
                total = part[:m] * np.uint64(pow(factor, covered, 2**64)) + total[size : size + m]
            covered += size
        rest >>= 1
        if rest:
            m = len(block) - size
            block = block[:m] * np.uint64(power) + block[size : size + m]
            power = power * power % 2**64
            size *= 2
    return mix(total + np.uint64(n))


def strings(column: pa.Array) -> np.ndarray:
    """Hash of each string as a whole."""
    data, offsets = raw(column)
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), "u8")
    full = np.flatnonzero(lengths)
    if len(full):
        heads = offsets[:-1][full]
        place = np.arange(len(data)) - np.repeat(heads, lengths[full])
        most = int(lengths.max())
        steps = mix(np.arange(min(most, 4096), dtype="u8") + _STEP)
        step = steps[place] if most <= 4096 else mix(place.astype("u8") + _STEP)
        out[full] = np.add.reduceat(BYTE[data] * step, heads)
    return mix(out + lengths.astype("u8") * _STEP)
