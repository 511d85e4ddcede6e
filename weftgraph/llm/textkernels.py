"""Vectorised byte kernels over Arrow string columns.

They work on the UTF-8 bytes of many documents at once, laid end to end, so that
no Python object is made for a word, a shingle or a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once; a longer document is handled alone.
PIECE_BYTES = 1 << 20

_DELIMITER = np.zeros(256, dtype=bool)
_DELIMITER[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(values: np.ndarray, factor: int, n: int) -> np.ndarray:
    while len(values) < n:
        values = np.concatenate([values, values * np.uint64(pow(factor, len(values), 2**64))])
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    global _powers, _inverses
    if n > 1 << 23:  # of one huge document: not kept
        return _grown(_powers, _BASE, n)[:n], _grown(_inverses, _BASE_INVERSE, n)[:n]
    _powers, _inverses = _grown(_powers, _BASE, n), _grown(_inverses, _BASE_INVERSE, n)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose texts have at most limit bytes, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = column_bytes(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and the number of its document."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_DELIMITER[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every prefix; see span_hashes."""
    power, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    return sums


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, inverse = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased words."""
    return mix(span_hashes(prefix_hashes(lowered(data)), starts, ends) + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct shingles of n lower-cased words, hashed to 64 bits.

    A shorter document has its whole sequence as one shingle; one without words, none.
    """
    starts, ends, doc = words(data, offsets)
    word = word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    m = len(word)
    rolled = np.zeros(max(0, m - n + 1), dtype=np.uint64)
    for j in range(n if m >= n else 0):
        rolled += word[j : m - n + 1 + j] * _STEP[j]
    rolled = mix(rolled)
    out = []
    for d, c in enumerate(count):
        a = first[d]
        if c >= n:
            x = np.sort(rolled[a : a + c - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif c:
            x = np.array([c * 0x51ED2701], dtype=np.uint64)
            for j in range(c):
                x += word[a + j : a + j + 1] * _STEP[j]
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
