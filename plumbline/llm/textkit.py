"""Vectorised tokenising and hashing of Arrow string columns with numpy.

A column is taken in slices of a few MB, so the arrays made here stay bounded
whatever a batch holds; only a single longer text makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers derived from the seed."""
    return mix(np.arange(1, n + 1, dtype=U64) + mix(np.full(1, seed, U64))) | U64(1)


_BYTE = constants(256, 1)
_PLACE = constants(4096, 2)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space (space, and 9 to 13).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words of letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with up to ``limit`` bytes each, or one row."""
    data, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of kept bytes; runs end with their row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = keep[data]
    edges = offs[(offs > 0) & (offs < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end); the runs are disjoint and in order."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    part = _BYTE[data[at]] * _PLACE[place & 4095]
    return mix(np.add.reduceat(part, first) + lengths.astype(U64) * _GOLDEN)


_SHINGLE = constants(64, 3)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of ``size`` words; a row
    with fewer words has its whole sequence as one, a row without words none."""
    counts = np.bincount(rows, minlength=n_rows)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, U64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * _SHINGLE[k % 64]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, U64)
    out = []
    for i in range(n_rows):
        a, n = int(bounds[i]), int(counts[i])
        if n >= size:
            out.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            out.append(mix((words[a : a + n] * _SHINGLE[:n]).sum(dtype=U64, keepdims=True) + np.full(1, n, U64) * _MIX2))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) over the slices of a text column: words between white
    space, A-Z lower-cased."""
    for row, data, offs in slices(column):
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offs, NOT_SPACE)
        yield row, shingles(run_hashes(data, starts, ends), rows, len(offs) - 1, size)
