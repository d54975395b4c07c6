"""Vectorised scanning of Arrow text columns: words, their hashes, shingles.

All functions work on the bytes of UTF-8 text. White space is the six ASCII
characters of ``[\\x20\\x09-\\x0D]``, which never occur inside a longer UTF-8
sequence, so words by bytes are words by characters.

Defined results: a null text is an empty one; empty and blank texts have no words; a
column of no rows gives nothing; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters of ASCII in lower case; bytes beyond ASCII as they are; all else a space.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LONG = 256
#: Bytes of text that are scanned at a time; what is made of them takes some twenty times as much.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _ODD[3]
    x ^= x >> np.uint64(27)
    x *= _ODD[4]
    x ^= x >> np.uint64(31)
    return x


def join64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of 64-bit values."""
    return mix64(a * _ODD[0] + (b ^ (b >> np.uint64(29))) * _ODD[2] + _ODD[1])


@dataclass
class Words:
    """The words of some consecutive rows. ``first[r]:first[r + 1]`` are row r's."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.first) - 1

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes; lanes are independent."""
        n = self.ends - self.starts
        seed = _ODD[lane]
        if not len(n):
            return np.zeros(0, dtype=np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        h = n.astype(np.uint64) * _ODD[2] + seed
        at, left, who = self.starts, np.where(n > _LONG, 0, n), None
        while True:
            piece = eight[at] & _KEEP[np.minimum(left, 8)]
            step = join64(h if who is None else h[who], piece)
            if who is None:
                h = step
            else:
                h[who] = step
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            who = more if who is None else who[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(n > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed=int(seed))
        return h

    def prefix_hashes(self, n_bytes: int) -> np.ndarray:
        """64-bit hash of each word's first bytes, eight at most."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        n = np.minimum(self.ends - self.starts, n_bytes)
        return join64(eight[self.starts] & _KEEP[n], np.full(1, np.uint64(n_bytes)))

    def room(self, k: int) -> np.ndarray:
        """Whether a run of ``k`` words starts at each word of its row."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.starts)) + k <= ends

    def rows(self) -> np.ndarray:
        """Row number, within the column, of each word."""
        return self.row + np.repeat(np.arange(self.n_rows), np.diff(self.first))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours; the last ``k - 1`` entries are meaningless."""
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                out = join64(out, _ahead(part, done))
            done += size
        size *= 2
        if size > k:
            return join64(out, np.full(1, np.uint64(k)))
        part = join64(part, _ahead(part, size // 2))


def run_minimum(h: np.ndarray, k: int) -> np.ndarray:
    """Smallest of ``k`` neighbours from each place on; the last ``k - 1`` entries are meaningless."""
    part, size = h, 1
    while size * 2 <= k:
        part, size = np.minimum(part, _ahead(part, size)), size * 2
    return np.minimum(part, _ahead(part, k - size)) if size < k else part


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by], with zeros beyond the end."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, to
        row = to


def words(column: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column, about a megabyte of whole rows at a time.

    ``table`` maps each byte before words are cut; ``lower`` stands for A-Z to a-z.
    """
    table = _LOWER if table is None and lower else table
    data, offsets = column_bytes(column)
    for row, to in pieces(offsets):
        part = data[offsets[row] : offsets[to]]
        off = offsets[row : to + 1] - offsets[row]
        if table is not None:
            part = table[part]
        inside = ~_IS_SPACE[part]
        before = np.empty(len(part) + 1, dtype=bool)  # before[i]: the byte before i is in the same word
        before[0], before[1:] = False, inside
        before[off] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(part) + 1, dtype=bool)
        after[-1], after[:-1] = False, inside
        after[off] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        yield Words(row, part, starts, ends, np.searchsorted(starts, off))
