"""Vectorised byte kernels shared by the text operators.

Every kernel works on the Arrow buffers of a string column: one flat uint8 array of UTF-8 bytes and
one offset per document, never on one Python string per row. Null text counts as empty.

Hashes are polynomial in Z/2^64 over per-byte random words, finished with a 64-bit mixer. They come
from prefix sums, so a window of any width costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes and words that hashes are taken of at once, so that what is held beside the text does not grow with it.
BLOCK_BYTES, BLOCK_WORDS = 1 << 18, 1 << 16
#: Powers that are kept from one step to the next.
MOST_POWERS = 1 << 22

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words of the class [^\x20\x09-\x0D]+
NON_SPACE = ~_WHITE
#: Bytes of words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when needed. Those for a very long text are not kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grown = []
            for b in (self.base, self.inverse):
                a = np.full(max(n, 1 << 16), b, U64)
                a[0] = 1
                grown.append(np.multiply.accumulate(a))
            if n > MOST_POWERS:
                return grown[0], grown[1]
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xD6E8FEB86659FD93)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about limit bytes of text each, with their bytes and offsets."""
    data, offsets = strings(batch.column(batch.schema.get_field_index(text)))
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's first word (n + 1 entries). Words end with their document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    up, _ = _BYTES.to(len(data))
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _BYTES.to(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of bytes, some rows at once."""
    n, width = rows.shape
    out = np.empty(n, U64)
    each = max(1, (1 << 19) // max(1, width))
    for at in range(0, n, each):
        part = np.ascontiguousarray(rows[at : at + each])
        starts = np.arange(len(part)) * width
        out[at : at + each] = span_hash(prefix_hash(part.ravel()), starts, starts + width)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words (ascending, apart), a block of them at once."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        out[i:j] = span_hash(prefix_hash(data[low : ends[j - 1]]), starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each run of width consecutive word hashes; windows that cross documents are the caller's to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for at in range(0, n, BLOCK_WORDS):
        own = hashes[at : at + BLOCK_WORDS + width - 1]
        up, down = _WORDS.to(len(own))
        total = np.empty(len(own) + 1, U64)
        total[0] = 0
        np.cumsum(own * up, out=total[1:])
        m = len(own) - width + 1
        out[at : at + m] = mix((total[width:] - total[:-width]) * down[:m] + U64(width))
    return out


def window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Indices of words at which a window of width words stays in its document."""
    return ranges(firsts[:-1], np.maximum(firsts[1:] - width + 1, firsts[:-1]))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The integers of all [start, end), concatenated."""
    lengths = np.maximum(ends - starts, 0)
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return out + np.arange(len(out))


def covered(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in a span [start, start + width)."""
    steps_ = np.zeros(n + 1, np.int64)
    np.add.at(steps_, starts, 1)
    np.add.at(steps_, np.minimum(starts + width, n), -1)
    return np.cumsum(steps_[:-1]) > 0


def counts_by(firsts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of marks in each [firsts[i], firsts[i + 1])."""
    total = np.concatenate(([0], np.cumsum(marks.astype(np.int64))))
    return total[firsts[1:]] - total[firsts[:-1]]


def long_of(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())
