"""Which of many known strings stand in which texts of their project, whatever stands around them.

Every place of a text is tested by hashes of the 4, 8, 16 or 32 bytes that begin
there, then, for each length that a known string has, by that hash, the hash of
the last bytes, the length and the project, against one bit set of bounded size.
What passes is cut out and meets the known strings in an equi-join on project
and string, which decides.  A wrong bit costs a row in that join and no result
is lost.  Work is in proportion to the texts and the results, whatever many
strings begin alike.

Defined cases: strings of fewer than ``LEAST`` bytes are not looked for; null
texts hold nothing; rows without a project have no known strings; very long
texts are read in pieces that overlap; empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.sources import shared

LEAST = 4
#: Bits of the set for each known string, and the most that the set has (64 MB); with more strings it only lets more rows through.
BITS_EACH, MOST_BITS = 32, 1 << 29
#: Places that are tested together.
PIECE = 1 << 18
#: Bytes of strings that a task hands on together.
MOST_BYTES = 4 << 20
_TOP = 5
_U = np.uint32
_JOIN = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], _U)
_SALT = np.array([0x2545F491, 0x7FEB352D, 0x846CA68B, 0x9E3779B9, 0xC4CEB9FE, 0xED558CCD], _U) | _U(1)
_BIT = (1 << np.arange(8)).astype(np.uint8)


def _windows(data: np.ndarray) -> list[np.ndarray]:
    """By p, the hash of the ``2 ** p`` bytes from every place on, as far as they reach."""
    out = [data.astype(_U)]
    for p in range(_TOP):
        h, w = out[-1], 1 << p
        out.append(h[:-w] * _JOIN[p] + h[w:])
    return out


def _level(n: int) -> int:
    """The p of the windows that a string of n bytes is tested by."""
    return min(_TOP, int(n).bit_length() - 1)


def _first(h: np.ndarray, p: int, shift: int) -> np.ndarray:
    x = (h ^ (h >> _U(15))) * _SALT[p]
    return (x ^ (x >> _U(13))) * _JOIN[1] >> _U(shift)


def _whole(first: np.ndarray, last: np.ndarray, n: int, project: np.ndarray, shift: int) -> np.ndarray:
    x = (first * _JOIN[2] ^ last) * _JOIN[0] + project + _U(n * 0x9E3779B1 & 0xFFFFFFFF)
    x = (x ^ (x >> _U(16))) * _JOIN[3]
    return (x ^ (x >> _U(15))) * _JOIN[4] >> _U(shift)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> _U(3)] & _BIT[at & _U(7)]) != 0


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _projects(column: pa.Array) -> np.ndarray:
    coded = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return np.array([zlib.crc32(p.encode()) for p in coded.dictionary.to_pylist()], _U)[coded.indices.to_numpy()] if len(column) else np.zeros(0, _U)


def _bits_of(column: pa.Array, project: pa.Array, shift: int) -> np.ndarray:
    """The bits of known strings."""
    data, ends = _bytes(column)
    h, by, n = _windows(data), _projects(project), np.diff(ends)
    out = [np.zeros(0, _U)]
    for size in np.unique(n).tolist():
        p, rows = _level(size), np.flatnonzero(n == size)
        first, last = h[p][ends[rows]], h[p][ends[rows] + size - (1 << p)]
        out += [_first(first, p, shift), _whole(first, last, size, by[rows], shift)]
    return np.unique(np.concatenate(out))


def _places(data: np.ndarray, ends: np.ndarray, by: np.ndarray, sizes: dict[int, list[int]], bits: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows, places and size of the pieces of text whose bits are all set; sizes: of known strings by level."""
    longest = max(s[-1] for s in sizes.values())
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        h = _windows(data[a : b + longest])
        for p, of in sizes.items():
            at = np.flatnonzero(_set(bits, _first(h[p][: b - a], p, shift)))
            at = at[(data[a + at] & 0xC0) != 0x80]
            row = np.searchsorted(ends, a + at, "right") - 1
            for n in of:
                fits = np.flatnonzero(a + at + n <= ends[row + 1])
                s, r = at[fits], row[fits]
                whole = _set(bits, _whole(h[p][s], h[p][s + n - (1 << p)], n, by[r], shift))
                s, r = a + s[whole], r[whole]
                # A letter that begins before the end and goes on behind it makes no string.
                ended = (s + n == ends[r + 1]) | ((data[np.minimum(s + n, len(data) - 1)] & 0xC0) != 0x80)
                if ended.any():
                    yield r[ended], s[ended], n


def _once(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string of n bytes once in a row, by comparing all its bytes."""

    def part(k: int) -> np.ndarray:
        """Bytes 8k to 8k + 8, the last ones again where fewer are left."""
        at, out = min(8 * k, max(0, n - 8)), np.zeros(len(starts), np.uint64)
        for i in range(at, min(at + 8, n)):
            out = out << np.uint64(8) | data[starts + i]
        return out

    keys = [*map(part, range(-(-n // 8))), rows]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return rows[order[new]], starts[order[new]]


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a piece of text together, one row at least."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def _found(data: np.ndarray, ends: np.ndarray, by: np.ndarray, sizes: dict[int, list[int]], bits: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows, places and size, each string once in a row."""
    for i, j in _groups(ends):
        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for rows, starts, n in _places(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], by[i:j], sizes, bits, shift):
            own[n].append((rows + i, starts + ends[i]))
        for n, x in own.items():
            yield *_once(data, np.concatenate([r for r, _ in x]), np.concatenate([s for _, s in x]), n), n


def candidates(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, project_id, value, once for each row of texts: what stands there and is a known string of the project, but for wrong bits; texts: doc_id, project_id, text; entries: project_id, value."""
    spark = texts.sparkSession
    lengths = entries.groupBy(F.octet_length("value").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes: dict[int, list[int]] = defaultdict(list)
    for n in sorted(r["size"] for r in lengths):
        sizes[_level(n)].append(n)
    n_bits = 1 << 16
    while n_bits < min(MOST_BITS, BITS_EACH * sum(r["n"] for r in lengths)):
        n_bits *= 2
    shift = 33 - n_bits.bit_length()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits_of(batch.column(1), batch.column(0), shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])

    words = entries.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 32, np.dtype("<u4"))
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    held = spark.sparkContext.broadcast(bits.view(np.uint8))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if sizes else ():
            data, ends = _bytes(batch.column(2))
            own, values, size = [], [], 0

            def out() -> pa.RecordBatch:
                rows = pa.array(np.concatenate(own))
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.concat_arrays(values)], ["doc_id", "project_id", "value"])

            for row, start, n in _found(data, ends, _projects(batch.column(1)), sizes, held.value, shift):
                most = max(1, MOST_BYTES // n)
                for r, s in ((row[i : i + most], start[i : i + most]) for i in range(0, len(row), most)):
                    pieces = data[s[:, None] + np.arange(n)].tobytes()
                    own.append(r)
                    values.append(pa.StringArray.from_buffers(len(r), pa.py_buffer((np.arange(len(r) + 1) * n).astype(np.int32)), pa.py_buffer(pieces)))
                    size += len(pieces)
                    if size >= MOST_BYTES:
                        yield out()
                        own, values, size = [], [], 0
            if own:
                yield out()

    rows = texts.select("doc_id", "project_id", "text").filter("project_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(cut, rows.select("doc_id", "project_id", F.col("text").alias("value")).schema)


def occurrences(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id and the rows of entries, once for each row of texts of their project that contains their value.

    texts: doc_id, project_id, text; entries: project_id, value (once in a project) and more.
    """
    known = shared.written(entries.filter((F.octet_length("value") >= LEAST) & F.col("project_id").isNotNull()), "known-strings")
    tried = candidates(texts, known.select("project_id", "value"))
    return tried.join(known, ["project_id", "value"]).select("doc_id", *entries.columns)
