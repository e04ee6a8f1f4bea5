"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms of a text are its words (lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``,
by 64-bit hash).  The vocabulary are all words of the labelled examples that are
learned from; their document frequencies are counted over all documents.  A
term weighs ``(1 + ln tf) * ln((1 + N) / (1 + df))``, times one plus its
log-likelihood ratio for the toxic class (none for words of the other class)
over ``LLR_SCALE``; vectors have unit length.  A block-max inverted index over
all examples gives the exact ``k`` nearest: the blocks of the highest upper
bounds are opened first, then all whose bound reaches the k-th best.  Votes
weighted by closeness go through a logistic curve fitted on leave-one-out votes
of the examples and weighted to the label shares of the whole table, so a score
is a calibrated probability; the neighbours are the evidence.

Bounds: at most ``MAX_EXAMPLES`` labelled rows a class are learned from, chosen
by a hash of their id among all of them, as far as they hold ``MAX_TERMS``
distinct terms a class together, one of each group of near copies (SimHash
within 3 bits).  The driver and each worker hold those terms and no texts.
Everything else reads all rows.  Counting and scoring are maps over documents;
what is shuffled are counts of the vocabulary, one for each task.

Defined cases: null texts are empty; a text without a term of the vocabulary
gets the share of toxic labels; very long texts are read whole, chunk by chunk;
labels of null ids or null values are ignored, of several labels of an id the
largest counts, of several texts the least; without examples of both classes
every score is the share of toxic labels (0 if there are none); equally near
examples are taken by smaller id; repeated rows give repeated results; empty
tables give empty results; other columns stay, but ``score`` and ``neighbours``
give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm import bytescan, workers
from spanveil.llm.simhash import fingerprint_text

MAX_EXAMPLES = 1000
MAX_TERMS = 4_000_000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are opened before any bound is compared.
FIRST = 6
LLR_SCALE = 10.0
SHRINK = 0.05
_U = np.uint64


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def counted(column: pa.Array) -> Iterator[tuple[bytescan.Chunk, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: distinct (document, word hash) pairs, sorted, and how often each occurs."""
    for c in bytescan.chunks(lowered(column)):
        w = bytescan.scan(c, bytescan.ALNUM)
        doc, word = w.document_of(), bytescan.word_hashes(c, w)
        order = np.lexsort((word, doc))
        doc, word = doc[order], word[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        yield c, doc[at], word[at], np.diff(np.append(at, len(doc)))


class Vocabulary:
    """Sorted word hashes, with a bitmap in front of the search."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(words & _U(0xFFFFF)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are words of the vocabulary, and their numbers."""
        which = np.flatnonzero(self.maybe[(hashes & _U(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[which]), len(self.words) - 1)
        right = self.words[at] == hashes[which]
        return which[right], at[right]


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first..last, and how long each range is."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


class BlockMaxIndex:
    """Postings by term and block of examples, and the greatest weight of each term in each block."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        """rows, terms, weights: the entries of the unit vectors."""
        self.ids, self.toxic, self.blocks = ids, toxic, -(-len(ids) // BLOCK)
        order = np.lexsort((rows, terms))
        self.rows, terms, self.weights = rows[order].astype(np.int32), terms[order], weights[order]
        cell = terms * self.blocks + self.rows // BLOCK
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.weights, start) if len(start) else np.zeros(0)
        self.block = (cell[start] % self.blocks).astype(np.int32)
        self.start = np.append(start, len(cell))
        self.first = np.searchsorted(cell[start], np.arange(n_terms + 1) * self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a positive cosine; ties go to the smaller id."""
        cells, n = _runs(self.first[terms], self.first[terms + 1])
        x = np.repeat(weights, n)
        block = self.block[cells]
        bounds = np.bincount(block, x * self.most[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        opened = np.zeros(self.blocks, bool)
        opened[order[:FIRST]] = True
        sums = self._sums(cells[opened[block]], x[opened[block]])
        if 0 <= without:
            sums[without] = 0
        if len(sums) > k:
            least = np.partition(sums, len(sums) - k)[len(sums) - k]
            more = ~opened & (bounds > 0) & (bounds >= least - 1e-12)
            if more.any():
                sums += self._sums(cells[more[block]], x[more[block]])
                if 0 <= without:
                    sums[without] = 0
                least = np.partition(sums, len(sums) - k)[len(sums) - k]
            rows = np.flatnonzero((sums > 0) & (sums >= least - 1e-9))
        else:
            rows = np.flatnonzero(sums > 0) if opened.all() else np.flatnonzero(sums + self._sums(cells[~opened[block]], x[~opened[block]]) > 0)
        rows = rows[np.lexsort((self.ids[rows], -np.round(sums[rows], 12)))[:k]]
        return rows, sums[rows]

    def _sums(self, cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, n = _runs(self.start[cells], self.start[cells + 1])
        return np.bincount(self.rows[at], self.weights[at] * np.repeat(x, n), len(self.ids))


@dataclass
class Model:
    """factor: weight of each term of the vocabulary at a frequency of one."""

    vocabulary: Vocabulary | None
    factor: np.ndarray
    index: BlockMaxIndex | None
    slope: float
    offset: float
    share: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = self.factor[terms] * (1 + np.log(counts))
        length = np.sqrt((x * x).sum())
        return x / length if length else x

    def vote(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        rows, scores = self.index.nearest(terms, self.vector(terms, counts), NEIGHBOURS, without)
        return float((scores * (2 * self.index.toxic[rows] - 1)).sum() / (scores.sum() + SHRINK)), rows, scores

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all rows; and the neighbours that voted: how many by row, their rows in the index, their cosines."""
        out = np.full(len(column), self.share)
        n_found, near, cosines = np.zeros(len(column), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
        if self.index is None:
            return out, n_found, near[0], cosines[0]
        for c in bytescan.chunks(lowered(column)):
            w = bytescan.scan(c, bytescan.ALNUM)
            which, at = self.vocabulary.found(bytescan.word_hashes(c, w))
            pairs, counts = np.unique(w.document_of()[which] * len(self.factor) + at, return_counts=True)
            docs, first = np.unique(pairs // len(self.factor), return_index=True)
            terms = pairs % len(self.factor)
            for d, a, b in zip(docs.tolist(), first.tolist(), [*first.tolist()[1:], len(pairs)]):
                vote, rows, scores = self.vote(terms[a:b], counts[a:b])
                if len(rows):
                    out[c.first + d] = 1 / (1 + np.exp(-(self.slope * vote + self.offset)))
                    n_found[c.first + d] = len(rows)
                    near.append(rows)
                    cosines.append(scores)
        return out, n_found, np.concatenate(near), np.concatenate(cosines)


def _calibrated(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a light ridge."""
    x, theta = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (toxic - p)) - 1e-2 * theta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


@dataclass
class Examples:
    """Labelled rows: ids, classes, where each one's terms begin, the terms' hashes and counts."""

    ids: np.ndarray
    toxic: np.ndarray
    begins: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, toxic: np.ndarray, prints: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> Examples:
        """One example of each group of near copies, the first."""
        alone = np.ones(len(ids), bool)
        for i in range(1, len(ids)):
            alone[i] = not (np.bitwise_count(prints[:i][alone[:i]] ^ prints[i]) <= 3).any()
        keep = np.flatnonzero(alone)
        sizes = [len(terms[i]) for i in keep]
        flat = lambda x, t: np.concatenate([np.zeros(0, t), *[x[i] for i in keep]]).astype(t)
        return Examples(ids[keep], toxic[keep], np.cumsum([0, *sizes]), flat(terms, _U), flat(counts, np.int64))


def fit(examples: Examples, vocabulary: np.ndarray, frequencies: np.ndarray, n_documents: int, share: float) -> Model:
    """vocabulary: sorted hashes of the examples' terms; frequencies: documents of the corpus that hold each; share: of toxic labels in the whole table."""
    toxic = examples.toxic
    if len(set(toxic.tolist())) < 2 or not len(vocabulary):
        return Model(None, np.zeros(0), None, 0.0, 0.0, share)
    term = np.searchsorted(vocabulary, examples.words)
    row = np.repeat(np.arange(len(toxic)), np.diff(examples.begins))
    n1, n = float(toxic.sum()), float(len(toxic))
    n0 = n - n1
    df = np.bincount(term, minlength=len(vocabulary))
    k1 = np.bincount(term, weights=toxic[row], minlength=len(vocabulary))
    k0 = df - k1

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    llr = 2 * (part(k1, n1 * df / n) + part(k0, n0 * df / n) + part(n1 - k1, n1 * (n - df) / n) + part(n0 - k0, n0 * (n - df) / n))
    factor = np.log((1 + n_documents) / (1 + np.minimum(frequencies, n_documents))) * (1 + np.where(k1 * n0 > k0 * n1, np.maximum(llr, 0.0), 0.0) / LLR_SCALE)
    model = Model(Vocabulary(vocabulary), factor, None, 0.0, 0.0, share)
    weights = factor[term] * (1 + np.log(examples.counts))
    length = np.sqrt(np.bincount(row, weights * weights, len(toxic)))
    weights = weights / np.where(length > 0, length, 1.0)[row]
    # Examples that share their weightiest term stand together, which makes the blocks' bounds tight.
    heaviest = np.full(len(toxic), -1, np.int64)
    by_weight = np.argsort(weights, kind="stable")
    heaviest[row[by_weight]] = term[by_weight]
    near = np.lexsort((examples.ids, heaviest))
    place = np.empty(len(near), np.int64)
    place[near] = np.arange(len(near))
    model.index = BlockMaxIndex(examples.ids[near], toxic[near], place[row], term, weights, len(vocabulary))
    votes = np.zeros(len(toxic))
    for i, (a, b) in enumerate(zip(examples.begins, examples.begins[1:])):
        order = np.argsort(term[a:b], kind="stable")
        votes[i] = model.vote(term[a:b][order], examples.counts[a:b][order], without=int(place[i]))[0] if b > a else 0.0
    model.slope, model.offset = _calibrated(votes, toxic, np.where(toxic == 1, share / n1, (1 - share) / n0) * n)
    return model


def held_out(id_: str = "doc_id"):
    return F.crc32(F.col(id_).cast("string")) % 5 == 0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = pc.fill_null(batch.column(2), "")
        prints = np.array([fingerprint_text(t.encode()) for t in raw.to_pylist()], _U)
        for c, doc, word, count in counted(raw):
            n = c.last - c.first
            ends = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.first, n), batch.column(1).slice(c.first, n), pa.array(prints[c.first : c.last].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(word.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
                ["doc_id", "toxic", "fp", "terms", "counts"],
            )


def examples_of(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> tuple[Examples, float]:
    """Examples among the labelled rows that are not held out, and the share of toxic ones among all of those."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64(F.lit("examples"), "doc_id"), F.col("doc_id"))
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_examples).union(known.filter("toxic = 0").orderBy(*order).limit(max_examples))
    # At most 2 * max_examples ids: a broadcast of fixed size.
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    read = texts.select("doc_id", "toxic", "text").mapInArrow(workers.lean(_terms), "doc_id long, toxic int, fp long, terms array<long>, counts array<int>")
    sofar = F.sum(F.size("terms")).over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = read.withColumn("sofar", sofar).filter(F.col("sofar") <= max_terms).drop("sofar").toArrow().sort_by("doc_id").combine_chunks()
    lists = lambda k, t: [x.values.to_numpy().astype(t) for x in rows[k]]
    terms = [x.view(_U) for x in lists("terms", np.int64)]
    total = sum(shares.values())
    return Examples.of(rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64), rows["fp"].to_numpy().astype(np.int64).view(_U), terms, lists("counts", np.int64)), shares.get(1, 0) / total if total else 0.0


def frequencies(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and how many documents there are."""
    held = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(held.value.words), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for c in bytescan.chunks(lowered(batch.column(0))):
                w = bytescan.scan(c, bytescan.ALNUM)
                which, at = held.value.found(bytescan.word_hashes(c, w))
                pairs = np.unique(w.document_of()[which] * len(counts) + at)
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], rows))], ["term", "n"])

    if not len(vocabulary):
        return np.zeros(0, np.int64), documents.count()
    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(workers.lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    term, n, out = rows["term"].to_numpy(), rows["n"].to_numpy(), np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def learn(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit on the labelled rows that are not held out, with document frequencies of all documents."""
    workers.small_batches(documents.sparkSession)
    examples, share = examples_of(documents, labels, max_examples)
    vocabulary = np.unique(examples.words)
    return fit(examples, vocabulary, *frequencies(documents, vocabulary), share)


def scored(documents: DataFrame, model: Model, text_col: str = "text", evidence: bool = True) -> DataFrame:
    """The rows of documents with score, and the neighbours that voted, added; clashing columns give way."""
    workers.small_batches(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("score", "neighbours")]
    held = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*[F.col(text_col).cast("string").alias(text_col) if c == text_col else c for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, n, near, cosines = held.value.score(batch.column(names.index(text_col)))
            extra = [pa.array(score)]
            if evidence:
                index = held.value.index
                ids, toxic = (index.ids[near], index.toxic[near].astype(np.int32)) if index else (near, near.astype(np.int32))
                votes = pa.StructArray.from_arrays([pa.array(ids), pa.array(cosines), pa.array(toxic)], ["doc_id", "similarity", "toxic"])
                extra.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), votes))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "score", *["neighbours"] * evidence])

    schema = rows.withColumn("score", F.lit(0.0))
    if evidence:
        schema = schema.withColumn("neighbours", F.array().cast("array<struct<doc_id: long, similarity: double, toxic: int>>"))
    return rows.mapInArrow(workers.lean(run), schema.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
