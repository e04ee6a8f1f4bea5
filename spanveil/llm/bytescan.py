"""Whole-text word scanning over Arrow string columns, vectorised with numpy.

Everything works on the UTF-8 bytes of whole texts.  An Arrow batch is walked
in chunks of about ``CHUNK_BYTES``; a chunk holds whole documents only, so one
longer text makes a longer chunk and is never cut.

Words are maximal runs of bytes whose class table entry is 1; a word never
crosses the border between two documents although their bytes are adjacent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: 1 for the bytes of ``[^\x20\x09-\x0D]``.
NON_SPACE = np.array([0 if b in _SPACES else 1 for b in range(256)], np.uint8)
#: 1 for the bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z.
ALNUM = np.array([1 if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)
#: A-Z to a-z, every other byte itself.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LOWER_TABLE = np.frombuffer(LOWER, np.uint8)

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values without linear structure."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd 64-bit multiplier and of its inverse, grown on demand."""

    def __init__(self, multiplier: int):
        self.m = multiplier | 1
        self.inverse = pow(self.m, -1, 1 << 64)
        self.n, self.up, self.down = 0, np.zeros(0, _U), np.zeros(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1024)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(self.n - 1, m, _U)])) for m in (self.m, self.inverse))
        return self.up[:n], self.down[:n]


#: Ways to hash words; all but the first are for sets in which words share a hash.
BYTE_POWERS = tuple(map(Powers, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))
_BYTE_POWERS = BYTE_POWERS[0]
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[e] - P[s] = sum of values[j] * m**j for s <= j < e, modulo 2**64."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers.upto(len(values))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Position-free hashes of values[s:e], mixed with the length."""
    down = powers.upto(len(sums))[1]
    return mix64((sums[ends] - sums[starts]) * down[starts] ^ mix64((ends - starts).astype(_U)))


@dataclass
class Chunk:
    """Whole documents: rows first..last of the batch, their bytes, and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> Chunk:
        return Chunk(self.first, self.last, _LOWER_TABLE[self.data], self.offsets)


@dataclass
class Words:
    """Words of a chunk: byte starts and ends, and per document the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Walk a string column in chunks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Chunk(i, j, every[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def scan(chunk: Chunk, table: np.ndarray) -> Words:
    n = len(chunk.data)
    inside = np.zeros(n + 2, np.uint8)
    inside[1:-1] = table[chunk.data]
    here = inside[1:-1]
    before = inside[:-2].copy()
    after = inside[2:].copy()
    borders = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    before[borders] = 0
    after[borders - 1] = 0
    starts = np.flatnonzero(here > before)
    ends = np.flatnonzero(here > after) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def word_hashes(chunk: Chunk, words: Words, way: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    sums = prefix_sums(_BYTE_VALUES[chunk.data], BYTE_POWERS[way])
    return range_hash(sums, words.starts, words.ends, BYTE_POWERS[way])


def hash_of(word: bytes) -> int:
    """The hash that word_hashes gives to a word with these bytes."""
    data = np.frombuffer(word, np.uint8)
    c = Chunk(0, 1, data, np.array([0, len(data)]))
    return int(word_hashes(c, Words(np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])
