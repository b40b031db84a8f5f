"""Arrow string columns as flat byte arrays, and 64-bit word hashes computed on them without Python strings.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered first. Both work on UTF-8 bytes, because
all of these are single bytes that never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and that of its last element."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(left, dtype=_U) * _U(0x9E3779B97F4A7C15) + np.asarray(right, dtype=_U))


BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
STEP = _U(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least), so that temporary arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words per row) for rows cut out by ``offsets`` (which start at 0)."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, _U), np.zeros(n, np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    head = inside & first[:-1]
    head[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(head)
    if len(starts) == 0:
        return np.zeros(0, _U), np.zeros(n, np.int64)
    letters = LOWER[data[inside]]
    place = np.cumsum(inside, dtype=np.int64)[starts] - 1
    lengths = np.diff(place, append=len(letters))
    with np.errstate(over="ignore"):
        values = BYTE[letters]
        values *= powers(int(lengths.max()))[np.arange(len(letters)) - np.repeat(place, lengths)]
        sums = np.add.reduceat(values, place)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(sums ^ mix(lengths.astype(_U))), counts


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, its position in the row) for rows of the given lengths."""
    counts = np.asarray(counts, dtype=np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
