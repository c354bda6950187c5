"""Words and word shingles of Arrow text columns as 64-bit fingerprints, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Its fingerprint is
a polynomial over a fixed random byte table, modulo 2**64, then mixed. Whole columns go through
NumPy in blocks of `BLOCK` bytes that end between words, so memory does not follow the text length
(one unbroken word is the only thing that may widen a block).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 17
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: bytes of words that punctuation and digits end as well
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(U64) | U64(1)
_POWERS: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    hashes: np.ndarray  #: one fingerprint per word, rows one after the other
    offsets: np.ndarray  #: words of row i are offsets[i]:offsets[i + 1]
    starts: np.ndarray  #: first byte of each word in `data`
    ends: np.ndarray
    data: np.ndarray  #: UTF-8 bytes of the column
    prefixes: tuple = ()  #: fingerprints of the words' first k bytes, for each k asked for


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, U64(base))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _block(data: np.ndarray, row_starts: np.ndarray, alphabet: np.ndarray, prefixes: tuple, values: np.ndarray) -> tuple:
    inside = alphabet[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = row_starts[row_starts < len(data)]
    begins[rows] = inside[rows]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    rows = rows[rows > 0] - 1
    stops[rows] = inside[rows]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    scale = down[starts]
    heads = [mix((total[np.minimum(starts + k, ends)] - total[starts]) * scale + U64(0x9D3F17 + k)) for k in prefixes]
    return mix((total[ends] - total[starts]) * scale + U64(0x51ED27)), starts, ends, heads


def words(column: pa.Array | pa.ChunkedArray, alphabet: np.ndarray = _IN_WORD, prefixes: tuple = (), fold: bool = True) -> Words:
    """The words of each row; `alphabet` marks the bytes a word is made of, and without `fold` A-Z stay apart from a-z."""
    data, bounds = bytes_of(column)
    hashes, starts, ends, heads = [], [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data):  # back to the last gap, or on to the next one
            gaps = np.flatnonzero(~alphabet[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(len(data), stop + BLOCK)
        low, high = np.searchsorted(bounds, (at, stop))
        h, s, e, p = _block(data[at:stop], np.unique(bounds[low:high]) - at, alphabet, prefixes, _BYTE if fold else _EXACT)
        hashes.append(h), starts.append(s + at), ends.append(e + at), heads.append(p)
        at = stop
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(bounds), np.int64), none, none, data, tuple(np.zeros(0, U64) for _ in prefixes))
    first = np.concatenate(starts)
    return Words(np.concatenate(hashes), np.searchsorted(first, bounds), first, np.concatenate(ends), data,
                 tuple(np.concatenate(p) for p in zip(*heads)))


def row_index(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every run of `width` words of each row, repeats included; a row with fewer
    words has one, of the whole row, and a row without words none. Returns values and row offsets."""
    counts = np.diff(offsets)
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(out_counts)))
    if not out[-1]:
        return np.zeros(0, U64), out
    if (counts >= width).all():
        at = np.arange(out[-1]) + row_index(out) * (width - 1)
    else:
        at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], out_counts)
    padded = np.concatenate((hashes, np.zeros(width, U64)))
    value = padded[at] * _PLACE[0]
    for k in range(1, width):
        value += padded[at + k] * _PLACE[k]
    short = np.flatnonzero((counts < width) & (counts > 0))
    for row in short.tolist():  # of at most `width` words each
        part = hashes[offsets[row] : offsets[row + 1]]
        value[out[row]] = np.append(part * _PLACE[: len(part)], _PLACE[width + len(part)]).sum(dtype=U64)
    return mix(value), out


def row_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    keep[firsts] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[offsets]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Row ranges of a batch with at most `most` bytes of text each (one longer text stands alone)."""
    bounds = bytes_of(batch.column(column))[1]
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
