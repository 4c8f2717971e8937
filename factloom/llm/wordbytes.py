"""Words of whole Arrow text columns as numpy arrays over the UTF-8 bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. All work is done for many rows at
once; a chunk holds whole rows of about ``CHUNK_BYTES`` of text (a longer row is a chunk of its own),
so that memory depends on the longest text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX_1
    x = (x ^ (x >> _U(27))) * _MIX_2
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:  # arrays for rarer, longer texts aren't kept
            _powers[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; equal spans have equal hashes wherever they lie."""
    n = len(values) + 1
    sums = np.zeros(n, _U)
    np.cumsum(values * powers(base, n)[:-1], out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _MIX_2)


@dataclass
class Chunk:
    """Rows ``first`` to ``first + len(count) - 1`` of a batch."""

    first: int
    data: np.ndarray  # bytes of the rows
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    count: np.ndarray  # words of each row
    at: np.ndarray  # index of each row's first word; one more at the end

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(_U) + _U(1), _BYTE_BASE, self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """Each word's position in its row."""
        return np.arange(len(self.start)) - np.repeat(self.at[:-1], self.count)


def word_span_hashes(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(word_hashes, _WORD_BASE, starts, ends)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of some UTF-8 bytes as a text column."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    where = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])]).cast(pa.string())


def chunks(column: pa.Array, lower: bool = False, chunk_bytes: int = CHUNK_BYTES, separator: np.ndarray = SEPARATOR) -> Iterator[Chunk]:
    """The chunks of a text column; null texts have no words. ``separator`` tells the bytes that no word holds."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk_bytes, side="right")) - 1)
        yield _chunk(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, separator)
        a = b


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool, separator: np.ndarray) -> Chunk:
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]  # a row's end also ends a word
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(start, offsets)
    return Chunk(first, data, start, end, np.diff(at), at)
