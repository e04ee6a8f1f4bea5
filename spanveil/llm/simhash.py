"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Three differing bits touch
three bytes at most, so linked fingerprints share at least ``8 - 3 = 5``
positional bytes.  The index posts every distinct fingerprint under sets of
``width`` positional bytes, chosen so that any five shared positions contain
one of the sets; so a pair is tallied within the list of such a set: its shared
positional bytes are counted, pairs reaching five are kept, and their differing
bits verified.

Scale: equal fingerprints are collapsed first, so copies cost one row.  Posting
lists longer than ``block`` are cut into blocks and compared block against
block in separate tasks.  A comparison emits a spanning forest of its links,
not all pairs, which keeps every component whole.  Components come from
joins (large-star, small-star), with each round written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any
other; very long texts are hashed whole; a null doc_id takes no part in naming a
component unless all ids of the component are null (component_id is then null);
rows that share an id or repeat give a result each; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bytescan, scratch, workers
from spanveil.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 3
BLOCK = 2048
#: Positional bytes of a posting key: 14 keys of 32 bits for each fingerprint.
WIDTH = 4


def fingerprint_text(data: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half of its shingles' hashes."""
    words = data.translate(bytescan.LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                n = c.last - c.first
                fp = np.fromiter((fingerprint_text(c.text(i)) for i in range(n)), np.uint64, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, n), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(workers.lean(run), "doc_id long, fp long")


def position_sets(width: int, shared: int = 8 - BITS) -> list[tuple[int, ...]]:
    """Sets of ``width`` of the 8 byte positions such that any ``shared`` positions contain one; found greedily."""
    left = set(combinations(range(8), shared))
    out = []
    while left:
        best = max(combinations(range(8), width), key=lambda s: (sum(set(s) <= set(x) for x in left), [-p for p in s]))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


def _forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b (within a, if b is None)."""
    points = a if b is None else np.concatenate([a, b])
    parent = list(range(len(points)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    other, shift = (a, 0) if b is None else (b, len(a))
    for i in range(len(a)):
        x = other[i + 1 :] ^ a[i] if b is None else other ^ a[i]
        if not len(x):
            continue
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = np.flatnonzero(shared >= 8 - bits)
        near = near[np.bitwise_count(x[near]) <= bits]
        for j in (near + (i + 1 if b is None else shift)).tolist():
            p, q = top(i), top(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left.append(i)
                right.append(j)
    return points[left], points[right]


def links(distinct: DataFrame, bits: int = BITS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that join all within ``bits`` differing bits."""
    sets = position_sets(width, 8 - bits)
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(255)
    keys = F.array(*[sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(k).cast("long") * (1 << (8 * width))) for k, s in enumerate(sets)])
    posted = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tiles = (
        posted.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(cells).alias("cell"))
        .select("key", "cell.i", "cell.j", "own", "fp")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "own", "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]))
            rows = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            if len(new):
                held = [rows[:, new[-1] :]]
                yield _links_of(rows[:, : new[-1]], new, bits)
            else:
                held = [rows]
        if held and held[0].shape[1]:
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            yield _links_of(rows, np.append(new, rows.shape[1]), bits)

    return tiles.mapInArrow(workers.lean(compare), "u long, v long")


#: Groups of up to so many rows are compared together, row against following row.
SMALL = 8


def _links_of(rows: np.ndarray, ends: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links of whole groups; rows: key, i, j, own, fp, sorted; ends: where each group ends."""
    fp = np.ascontiguousarray(rows[4]).view(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    group = np.repeat(np.arange(len(ends)), sizes)
    small = sizes[group] <= SMALL
    us, vs = [], []
    for d in range(1, SMALL):
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        x = fp[a] ^ fp[a + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) if len(x) else np.zeros(0, np.int64)
        a = a[(shared >= 8 - bits) & (np.bitwise_count(x) <= bits)]
        us.append(fp[a])
        vs.append(fp[a + d])
    for g in np.flatnonzero(sizes > SMALL).tolist():
        a, b = starts[g], ends[g]
        if rows[1, a] == rows[2, a]:
            u, v = _forest(fp[a:b], None, bits)
        else:
            mine = rows[3, a:b] == rows[1, a]
            u, v = _forest(fp[a:b][mine], fp[a:b][~mine], bits)
        us.append(u)
        vs.append(v)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    workers.small_batches(documents.sparkSession)
    with scratch.clearing(documents.sparkSession):
        marked = scratch.written(fingerprints(documents, id_col, text_col), "fingerprints")
        classes = scratch.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "fingerprint-classes")
        edges = scratch.written(links(classes.select("fp"), bits), "simhash-links").distinct()
        named = connected_components(edges)
        linked = classes.join(named, classes.fp == named.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
        smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
        members = linked.join(smallest, "component").select("fp", "component_id")
        rows = marked.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return scratch.written(rows, "near-duplicates", stays=True)


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
