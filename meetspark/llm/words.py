"""Vectorised word spans and hashes over the UTF-8 bytes of Arrow string columns.

A batch is handled in blocks of a few MB, so memory stays bounded however long the batch is. Words are maximal runs of
the bytes outside a separator set; they never cross from one text to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))


@dataclass
class Block:
    """Some consecutive texts of a batch: their bytes, and the word spans of all of them in order."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray  # of the texts in data, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text's words in starts, one more than texts

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, separator: np.ndarray = WHITE_SPACE, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        stop = min(stop, n)
        yield _block(slice(row, stop), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], separator)
        row = stop


def _block(rows: slice, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Block:
    word = ~separator[data]
    begins, closes = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = word[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[tails] = word[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Block(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class RangeHash:
    """64-bit polynomial hashes of ranges of a sequence, by prefix sums."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        base, inverse = (_BASE, _BASE_INVERSE)
        n = len(values)
        self.salt = _U(salt)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((values + _U(1)) * _powers(n, base)[:n], dtype=_U, out=self.sums[1:])
        self.back = _powers(n, inverse)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(_U) + self.salt)


LONG_WORD = 64


def word_hashes(block: Block, data: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word of a block, eight bytes of all words at a time; of longer words than ``LONG_WORD`` bytes by
    xxHash. data: other bytes of the same length, such as lower-cased ones."""
    return span_hashes(block.data if data is None else data, block.starts, block.ends)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, as a view; beyond its end they are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


_FIRST_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=_U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes ``[start, end)`` of each span."""
    size = ends - starts
    view = eights(data)
    out = mix(size.astype(_U) * _BASE + _U(seed))
    some, at, left = slice(None), starts, size
    for step in range(LONG_WORD // 8):
        if step:
            some = np.flatnonzero(size > 8 * step)
            if not len(some):
                break
            at, left = starts[some] + 8 * step, size[some] - 8 * step
        out[some] = mix(out[some] ^ (view[at] & _FIRST_BYTES[np.minimum(left, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed)
    return out


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        keep = left <= right
        best, at = np.where(keep, left, right), np.where(keep, at[: len(keep)], at[step:])
        have += step
    return at[:n]
