"""Near copies: documents that share at least four fifths of their word 5-grams, found without loss by prefix filtering.

The similarity is the exact Jaccard coefficient of the sets of word 5-grams (of
a shorter text, the text).  Of two sets that reach ``least``, the first
``n - ceil(least * n) + 1`` members in one common order share a member, so the
sets posted under those members meet in a posting list.  The order puts common
5-grams last, by counts of cells into which 5-grams are hashed; that keeps lists
short, and any order loses nothing.  Of all lists where a pair meets, that of its
first common member counts: no common member stands before it, so enough members
must stand from there on in both sets, and a pair for which they do not is left
to another list or is none.

Scale: equal texts are collapsed first.  Two rounds verify candidates: each
list's members against its least member, then the pairs of a list that lie in
different components still and may have their first common member there.  A group of copies costs its size, not its square.
Shingles are never stored for all documents: prefixes are read from the texts,
and whole sets from one text of each class that a candidate pair still holds
after a bitmap filter: the parities of ``SKETCH`` groups of shingles differ in no
more groups than the sets differ in members, so pairs of more are no copies.

SimHash links (``simhash``, contract values) join components too.

Defined cases: null texts are empty; empty texts are copies of each other; very
long texts are read whole; of null ids as in ``simhash``; rows that share an id
are rows of their own; repeated rows are copies; an empty table gives an empty
result; other columns are ignored, but for those named in ``carry``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm import bytescan, scratch, simhash, workers
from spanveil.llm.components import connected_components

SIZE = 5
LEAST = (4, 5)
#: Orders the 5-grams: cells of counts, in so many slices; a task counts to 65,535 in a cell.
CELLS, SLICES = 1 << 22, 64
#: Bits of a class's parity bitmap.
SKETCH = 2048


def shingles(data: bytes, size: int = SIZE) -> tuple[int, np.ndarray]:
    """Hash of the words of a text, and the sorted hashes of its word n-grams."""
    words = data.translate(bytescan.LOWER).split()
    joined = b" ".join(words)
    h = xxhash.xxh3_64_intdigest
    if len(words) <= size:
        return h(joined), np.array([h(joined)] if words else [], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return h(joined), np.unique(np.array([h(joined[a:b]) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _made(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, list[bytes], np.ndarray, list[np.ndarray]]]:
    """Chunk by chunk: first row, rows, texts, their hashes of words, their shingles."""
    for c in bytescan.chunks(batch.column(text)):
        texts = [c.text(i) for i in range(c.last - c.first)]
        made = [shingles(t) for t in texts]
        yield c.first, len(texts), texts, np.array([m[0] for m in made], np.uint64).view(np.int64), [m[1] for m in made]


def sketches(grams: list[np.ndarray]) -> pa.Array:
    """Per set the parities of its members by their lowest bits, as 64-bit integers."""
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    group = np.concatenate(grams) & (SKETCH - 1) if grams else np.zeros(0, np.int64)
    odd = np.bincount(row * SKETCH + group, minlength=len(grams) * SKETCH) & 1
    return pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1) * (SKETCH // 64), pa.int32()), pa.array(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)))


def cells(grams: np.ndarray) -> np.ndarray:
    """The cell of each 5-gram, from its highest bits."""
    return (grams.view(np.uint64) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one for each slice of the task's counts (slice and counts set)."""
    total, seen, held = np.zeros(CELLS, np.uint16), [], 0
    empty = None

    def count() -> None:
        total[:] = np.minimum(total + np.bincount(cells(np.concatenate(seen)), minlength=CELLS), 65_535)
        seen.clear()

    for batch in batches:
        names = ["cls", "fp", "slice", "counts", "n", "sketch", "doc_id", *batch.schema.names[2:]]
        empty = batch.slice(0, 0)
        for first, n, texts, cls, grams in _made(batch, 1):
            fp = np.fromiter(map(simhash.fingerprint_text, texts), np.uint64, n).view(np.int64)
            seen += grams
            held += sum(map(len, grams))
            if held > CELLS // 4:
                count()
                held = 0
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(fp), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([len(g) for g in grams], pa.int32()), sketches(grams), batch.column(0).slice(first, n), *(x.slice(first, n) for x in batch.columns[2:])], names)
    if seen:
        count()
    if empty is not None:
        made = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(total.reshape(SLICES, -1)) if x.any()]
        n = len(made)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), *(pa.nulls(n, x.type) for x in (empty.column(0), *empty.columns[2:]))], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's counts of all tasks, as unsigned 32-bit integers."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(x), np.uint16)
            sums[k] = sums.get(k, 0) + x.astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, cls, grams in _made(batch, 0):
            yield pa.RecordBatch.from_arrays([pa.array(cls), _lists(grams)], ["cls", "grams"])


def _posted(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, cls, n, place: every set under the members of its prefix, and how many of its members stand before each."""
    total = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for x in counts.repartition("slice").mapInArrow(workers.lean(_summed), "slice int, counts binary").collect():
        total[x.slice] = np.frombuffer(x.counts, np.uint32)
    held = texts.sparkSession.sparkContext.broadcast(total.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for _, _, _, cls, grams in (m for batch in batches for m in _made(batch, 0)):
            n = np.array([len(g) for g in grams])
            gram, row = np.concatenate(grams), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((gram, often[cells(gram)], row))
            place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
            prefix = n - -(-n * LEAST[0] // LEAST[1]) + 1
            first = order[place < prefix[row]]
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, prefix, 0))])
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gram[first]))], ["cls", "n", "prefix"])

    heads = texts.select("text").mapInArrow(workers.lean(run), "cls long, n int, prefix array<long>")
    return heads.groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select(F.posexplode("prefix").alias("place", "gram"), "cls", "n").select("gram", "cls", "n", "place")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets reach the coefficient; the sets are read again from one text of each class in question."""
    workers.rested(texts.sparkSession)
    u, v = (classes.select(F.col("cls").alias(x), F.col("set").alias(f"{x}_set")) for x in "uv")
    differ = F.aggregate(F.zip_with("u_set.sketch", "v_set.sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    may = differ * sum(LEAST) <= (F.col("u_set.n") + F.col("v_set.n")) * (LEAST[1] - LEAST[0])
    pairs = scratch.written(pairs.distinct().join(u, "u").join(v, "v").filter(may).select("u", "v"), "candidates")
    ids = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    wanted = classes.join(ids, "cls", "left_semi").select("t.*")
    few = texts.join(wanted, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).select("text").mapInArrow(workers.lean(_sets), "cls long, grams array<long>")
    few = scratch.written(few, "candidate-sets")
    a, b = (few.select(F.col("cls").alias(x), F.col("grams").alias(f"{x}_grams")) for x in "uv")
    both = F.size(F.array_intersect("u_grams", "v_grams"))
    reach = both * sum(LEAST) >= (F.size("u_grams") + F.size("v_grams")) * LEAST[0]
    out = scratch.written(pairs.join(a, "u").join(b, "v").filter(reach).select("u", "v"), "verified")
    scratch.dropped(pairs, few)
    return out


def _close(x: str, y: str):
    return (F.col(x) * LEAST[1] >= F.col(y) * LEAST[0]) & (F.col(y) * LEAST[1] >= F.col(x) * LEAST[0])


def _first_common(n: str, i: str, m: str, j: str):
    """Whether sets of n and m members may have their first common member at their places i and j: the common ones, at least the share ``LEAST`` asks of both, all stand from there on."""
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * sum(LEAST) >= (F.col(n) + F.col(m)) * LEAST[0]


def jaccard_links(texts: DataFrame, classes: DataFrame, counts: DataFrame) -> DataFrame:
    """Links (u, v) between classes that join all whose 5-grams reach the coefficient.

    texts: t1, t2 (hashes) and text; classes: cls and the t1, t2 of one of its texts, as t; counts: slice and counts of tasks, from ``_read``.
    """
    by = Window.partitionBy("gram").orderBy("cls")
    # Rows stream through in order; lists of one member go.
    first, after = F.first(F.struct("cls", "n")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lead("cls").over(by)
    lists = _posted(texts, counts).withColumns({"f": first, "after": after}).filter("f.cls <> cls OR after IS NOT NULL")
    lists = scratch.written(lists.select("gram", "cls", "n", "place", F.col("f.cls").alias("first"), F.col("f.n").alias("first_n")), "shingle-lists")
    stars = lists.filter((F.col("cls") != F.col("first")) & _close("n", "first_n")).select(F.col("first").alias("u"), F.col("cls").alias("v"))
    edges = _verified(stars, texts, classes)
    named = connected_components(edges)
    known = lists.join(named.withColumnRenamed("node", "cls"), "cls", "left").select("gram", "cls", "n", "place", F.coalesce("component", "cls").alias("component"))
    mixed = known.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("gram")
    known = scratch.written(known.join(mixed, "gram"), "mixed-lists")
    # The smaller set's common members are at least 8 of 9 of its own, so it stands early in the list's order.
    early = known.filter((F.col("n") - F.col("place")) * sum(LEAST) >= F.col("n") * 2 * LEAST[0])
    a, b = early.toDF("gram", "u", "n", "i", "c"), known.toDF("gram", "v", "m", "j", "d")
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("u") < F.col("v")))
    cross = a.join(b, "gram").filter((F.col("c") != F.col("d")) & smaller & _first_common("n", "i", "m", "j")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    out = edges.union(_verified(cross, texts, classes))
    scratch.dropped(lists, known)
    return out


def texts_key(text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))


def near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, cls (hash of the words), component (least cls reachable), component_id (least id there) and the carried columns of every row."""
    workers.small_batches(documents.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = documents.select(texts_key(text).alias("t"), text.alias("text")).select("t.*", "text")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), texts_key(text).alias("t"), *carry)
    schema = ", ".join(["cls long, fp long, slice int, counts binary, n int, sketch array<long>, doc_id long, t struct<t1: long, t2: long>", *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)])
    read = scratch.written(rows.mapInArrow(workers.lean(_read), schema), "shingles")
    workers.rested(documents.sparkSession)
    marked, counts = read.filter("slice IS NULL"), read.filter("slice IS NOT NULL").select("slice", "counts")
    classes = scratch.written(marked.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.min("t").alias("t"), F.first(F.struct("n", "sketch")).alias("set")), "shingle-classes")
    prints = classes.groupBy("fp").agg(F.min("cls").alias("rep"))
    same = classes.join(prints, "fp").filter("cls <> rep").select(F.col("cls").alias("u"), F.col("rep").alias("v"))
    bits = simhash.links(prints.select("fp")).distinct()
    bits = bits.join(prints.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = scratch.written(jaccard_links(texts, classes, counts).union(same).union(bits), "near-links")
    workers.rested(documents.sparkSession)
    named = connected_components(edges)
    linked = classes.join(named, classes.cls == named.node, "left").select("cls", "first_id", F.coalesce("component", "cls").alias("component"))
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "cls", *carry).join(linked.join(smallest, "component").select("cls", "component", "component_id"), "cls").select("doc_id", "cls", "component", "component_id", *carry)
