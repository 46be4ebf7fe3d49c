"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes, straight from the UTF-8 buffers.

No Python object is made for a word. Blocks of about BLOCK bytes keep the work arrays small; a
longer text is cut at white space, so that memory per byte of a long text is a few bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_U = np.uint64
_BASE, _MOD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_INV = pow(_BASE, -1, _MOD)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTE_FOLD = _BYTE[FOLD]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_P, _Q = _powers(_BASE, BLOCK), _powers(_INV, BLOCK)


class Words(NamedTuple):
    starts: np.ndarray  #: byte offsets in the block
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: index of each text's first word, and the number of words


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; the whole of data is read once."""
    n = len(data)
    p, q = (_P, _Q) if n <= BLOCK else (_powers(_BASE, n), _powers(_INV, n))
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTE_FOLD if fold else _BYTE)[data] * p[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def _piece(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = IS_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[bounds] = True
    word = ~space
    starts = np.flatnonzero(word & edge[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    inner = bounds[(bounds > 0) & (bounds <= len(data))]
    after[inner - 1] = True
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, span_hashes(data, starts, ends, fold)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """Words of the texts that lie at offsets in data. fold: A-Z count as a-z."""
    n = len(data)
    if n <= BLOCK:
        starts, ends, hashes = _piece(data, offsets, fold) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    else:
        parts, lo = [], 0
        while lo < n:
            hi = min(n, lo + BLOCK)
            while hi < n and not (gap := np.flatnonzero(IS_SPACE[data[lo:hi]])).size:
                hi = min(n, hi + BLOCK)
            if hi < n:
                hi = lo + int(gap[-1]) + 1
            s, e, h = _piece(data[lo:hi], np.array([0, hi - lo]), fold)
            parts.append((s + lo, e + lo, h))
            lo = hi
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about BLOCK bytes, one text at least."""
    off, data = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; runs over a text's end are to be left out by the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= _U(0xA24BAED4963EE407)
            out += hashes[i : i + n]
    return mix(out)
