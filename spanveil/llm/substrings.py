"""Repeated word spans by compacting a De Bruijn graph of word k-mers.

An edge is a window of ``window`` consecutive words (its nodes are the windows
of one word less); an edge is repeated if its word sequence starts at two
places or more.  The graph is compacted before anything is joined: consecutive
edges of a document that share a minimizer (the least hash among the shorter
``k``-word grams of the window, at one place) form one nonbranching path
segment, so a document gives a row for about every fourteen words instead of
one for each.  Equal edges have equal minimizers at equal places, hence lie in
segments of the same minimizer.

Joins then compact: segments whose minimizer stands once are unique paths and
go; segments of equal content are repeated as a whole; only segments that
share a minimizer but not the content, where paths branch, are opened, one
representative each, into single edges and compared edge by edge.  Edges are
compared by two independent 64-bit hashes (the minimizer and the content).
Source coordinates (document, first word, edges) carry every segment; adjoining
ones merge into the spans reported.

Scale: counts combine before they are shuffled, joins have an exchange on both
sides (adaptive execution may split hot keys), and copies are never paired.
Intermediate tables are written to the shared folder.

Inside, a document goes by its id and a hash of its text, so rows that share an
id, or have none, keep their own coordinates.

Defined cases: null texts have no words; texts shorter than the window have no
edges; very long texts are read whole; rows with a null or a shared doc_id are
documents of their own; repeated rows repeat all their windows, so both lose
them; nothing depends on an order, so there are no ties; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bytescan, scratch, workers

WINDOW = 35
GRAM = 8
#: Segments of one minimizer from which its rows are dealt over several tasks, and over how many.
HOT, SALTS = 4096, 32

_GRAMS = bytescan.Powers(0xD6E8FEB86659FD93)
_EDGES = bytescan.Powers(0xA0761D6478BD642F)
_U = np.uint64


def _edge_sums(hashes: np.ndarray) -> np.ndarray:
    return bytescan.prefix_sums(bytescan.mix64(hashes ^ _U(0x589965CC75374CC3)), _EDGES)


def segments(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Path segments of a chunk: minimizer, content hash, document, first word (in the chunk), edges.

    hashes: of all words; first: per document the index of its first word, and the end.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(_U), none.view(_U), none, none, none
    sums = bytescan.prefix_sums(hashes, _GRAMS)
    at = np.arange(n - gram + 1)
    grams = bytescan.range_hash(sums, at, at + gram, _GRAMS)
    # The place of the leftmost least gram in each window, by doubling.
    width, size, least = window - gram + 1, 1, at
    while size < width:
        step = min(size, width - size)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(grams[b] < grams[a], b, a)
        size += step
    edge = np.arange(n - window + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = doc[: n - window + 1] == doc[window - 1 :]
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    start = edge[begins]
    number = np.cumsum(begins) - 1
    edges = np.bincount(number[valid], minlength=len(start))
    place = least[start]
    content = bytescan.range_hash(_edge_sums(hashes), start, start + edges + window - 1, _EDGES) ^ bytescan.mix64((place - start).astype(_U))
    return grams[place], content, doc[start], start, edges


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("k1"), F.hash(text).alias("k2"))


def path_segments(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """The segments of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bytescan.chunks(batch.column(2)):
                w = bytescan.scan(c, bytescan.NON_SPACE)
                m, content, doc, start, edges = segments(bytescan.word_hashes(c, w), w.first, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(doc + c.first)), batch.column(1).take(pa.array(doc + c.first)), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(edges.astype(np.int32))],
                    ["m", "c", "k1", "k2", "at", "edges"],
                )

    return documents.select("k1", "k2", "text").mapInArrow(workers.lean(run), "m long, c long, k1 long, k2 int, at int, edges int")


def _open_segments(wanted: DataFrame, documents: DataFrame, window: int) -> DataFrame:
    """The single edges of segments: m, edge hash, document, first word.  wanted: m, k1, k2, at, edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for c in bytescan.chunks(batch.column(2)):
                w = bytescan.scan(c, bytescan.NON_SPACE)
                sums = _edge_sums(bytescan.word_hashes(c, w))
                mine = lists.slice(c.first, c.last - c.first)
                flat = mine.flatten()
                doc = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy(zero_copy_only=False))
                m, at, edges = (flat.field(k).to_numpy() for k in range(3))
                edges = edges.astype(np.int64)
                step = np.arange(int(edges.sum())) - np.repeat(np.cumsum(edges) - edges, edges)
                local = np.repeat(at.astype(np.int64), edges) + step
                start = local + np.repeat(w.first[doc], edges)
                e = bytescan.range_hash(sums, start, start + window, _EDGES)
                row = pa.array(np.repeat(doc + c.first, edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(m, edges)), pa.array(e.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(local.astype(np.int32))], ["m", "e", "k1", "k2", "at"])

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "at", "edges")).alias("list"))
    joined = documents.select("k1", "k2", "text").join(lists, ["k1", "k2"])
    return joined.mapInArrow(workers.lean(run), "m long, e long, k1 long, k2 int, at int")


def repeated_edges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Segments of repeated edges of keyed documents: k1, k2, at (first word of the first edge), edges."""
    every = scratch.written(path_segments(docs, window, gram), "segments")
    shared = scratch.written(
        every.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1").select("m", (F.col("c0") < F.col("c1")).alias("branches"), (F.col("n") > HOT).alias("hot")),
        "shared-minimizers",
    )
    place = ["k1", "k2", "at", "edges"]
    # Rows of a hot minimizer are dealt over SALTS tasks; the narrow other side stands in each.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*place), F.lit(SALTS))).otherwise(0).cast("int")
    known = scratch.written(every.join(shared, "m").withColumn("salt", salt), "shared-segments")
    whole = known.filter("NOT branches").select(*place)
    branching = known.filter("branches")
    first = F.min(F.struct(*place))
    contents = scratch.written(branching.groupBy("m", "c", "hot").agg(F.count(F.lit(1)).alias("n"), first.alias("first")), "branching-contents")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = branching.join(contents.filter("n > 1").select("m", "c", F.explode(salts).alias("salt")), ["m", "c", "salt"]).select(*place)
    opened = scratch.written(_open_segments(contents.select("m", "first.*"), docs, window), "opened-edges")
    # One representative of each content is opened, so an edge seen twice lies in different contents.
    twice = opened.groupBy("m", "e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m", "e")
    branched = opened.join(twice, ["m", "e"]).select("k1", "k2", "at", F.lit(1).alias("edges"))
    return whole.unionByName(copied).unionByName(branched)


_SPANS = "array<struct<first_word: int, n_words: int>>"


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, spans of words under repeated edges (maximal), and the kept words joined by one space."""
    docs = _keyed(documents, id_col, text_col)
    workers.small_batches(documents.sparkSession)
    with scratch.clearing(documents.sparkSession):
        found = scratch.written(repeated_edges(docs, window, gram), "repeated-edges", stays=True)
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "edges")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for c in bytescan.chunks(batch.column(1)):
                w = bytescan.scan(c, bytescan.NON_SPACE)
                n = c.last - c.first
                mine = lists.slice(c.first, n)
                flat = mine.flatten()
                doc = np.repeat(np.arange(n), np.nan_to_num(mine.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                begin = w.first[doc] + flat.field(0).to_numpy()
                change = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + flat.field(1).to_numpy() + window - 1, -1)
                removed = np.cumsum(change)[:-1] > 0
                here = w.document_of()
                new = removed.copy()
                new[1:] &= ~removed[:-1] | (here[1:] != here[:-1])
                start = np.flatnonzero(new)
                length = np.bincount((np.cumsum(new) - 1)[removed], minlength=len(start))
                spans = pa.StructArray.from_arrays([pa.array((start - w.first[here[start]]).astype(np.int32)), pa.array(length.astype(np.int32))], ["first_word", "n_words"])
                ends = np.searchsorted(here[start], np.arange(n + 1)).astype(np.int32)
                # Kept words, each followed by one space that the last one loses.
                stay = ~removed
                sizes = (w.ends - w.starts)[stay] + 1
                out_end = np.concatenate([[0], np.cumsum(sizes)])
                take = np.repeat(w.starts[stay] - out_end[:-1], sizes) + np.arange(int(out_end[-1]))
                data = c.data[np.minimum(take, max(len(c.data) - 1, 0))].copy()
                data[out_end[1:] - 1] = 0x20
                kept_first = np.concatenate([[0], np.cumsum(stay)])[w.first]
                raw, bounds = data.tobytes(), out_end[kept_first]
                kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, n), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "spans", "kept"],
                )

    return docs.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "list").mapInArrow(workers.lean(run), f"doc_id long, n_words long, spans {_SPANS}, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT phrase FROM windows GROUP BY phrase HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows WHERE phrase IN (SELECT phrase FROM repeated)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM hits),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
