"""Approximate nearest neighbours by collision counting over sorted projections.

Every vector is projected on ``PROJECTIONS`` random unit directions.  A shard of
vectors keeps one sorted array for each direction; a query opens a window
around its own value in every array, and the windows widen round by round
(virtual rehashing: no array is built anew).  A vector that lies in the window
of at least ``threshold`` directions has collided often enough and is verified
by its exact distance.  A query rests when its k-th best verified distance is
within the radius that the windows stand for.

Scale: shards hold about ``SHARD`` vectors each, their number grows with the
table.  A shard is a partition that begins with its vectors; their arrays are
sorted once, then all queries stream through in blocks, and each gives its k
best only.  So what is shuffled is the vectors once, and the queries once for
each shard.  Equal vectors share all projections; they are collapsed to one row
with their ``k + 1`` smallest ids before anything else, by ranks that are
limited before the shuffle, so a vector that a third of the rows hold costs one
row.

Vectors that are null, zero, empty or hold null or non-finite components take
no part; vectors of another length than the query's are no candidates of it.
Rows equal in id and vector are one candidate; an id with several vectors is as
many candidates, but a query never finds its own id.  A query row that stands
several times gives its answers as often.  Ties of distance go to the smaller
id.  An empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm import scratch, workers

PROJECTIONS = 48
SHARD = 1 << 15
#: Vectors of a shard at least, where a table is cut for all cores.
LEAST = 1024
BLOCK = 64
K = 10
#: Share of directions in which a vector must collide.
THRESHOLD = 0.7
#: Half width of a window by radius, in standard deviations of a projected difference of that length.
WIDTH = 1.4
GROWTH = 1.2
#: Vectors of a shard that set the first radius, and its share of the least distance to them.
SAMPLE = 64
START = 0.7


def directions(dim: int, n: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    a = np.random.default_rng((seed, dim)).standard_normal((dim, n))
    return a / np.linalg.norm(a, axis=0)


class Shard:
    """Sorted projections of the vectors of a shard."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.axes = directions(vectors.shape[1])
        values = (vectors @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)
        self.need = int(np.ceil(THRESHOLD * len(values)))
        self.sample = vectors[np.random.default_rng(len(vectors)).permutation(len(vectors))[:SAMPLE]]

    def distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the rows and exact distances of verified vectors, at least k of them."""
        n, m = len(self.vectors), len(self.sorted)
        at = queries @ self.axes
        scale = WIDTH / np.sqrt(queries.shape[1])
        # Windows begin a little under the distance of the nearest of a few vectors: no answer depends on it, only the rounds.
        radius = np.array([START * np.sqrt(((self.sample - q) ** 2).sum(1).min()) for q in queries]) + 1e-9
        lo = np.stack([np.searchsorted(self.sorted[j], at[:, j]) for j in range(m)], 1)
        hi = lo.copy()
        counts = np.zeros((len(queries), n), np.uint8 if m < 256 else np.int32)
        out: list = [None] * len(queries)
        rest = np.arange(len(queries))
        while len(rest):
            half = radius[rest] * scale
            a = np.stack([np.searchsorted(self.sorted[j], at[rest, j] - half, "left") for j in range(m)], 1)
            b = np.stack([np.searchsorted(self.sorted[j], at[rest, j] + half, "right") for j in range(m)], 1)
            stay = []
            for i, q in enumerate(rest.tolist()):
                new = [self.order[j, x:y] for j, x, y in zip(range(m), a[i].tolist(), np.maximum(lo[q], a[i]).tolist())]
                new += [self.order[j, x:y] for j, x, y in zip(range(m), hi[q].tolist(), b[i].tolist())]
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(counts.dtype)
                rows = np.flatnonzero(counts[q] >= self.need)
                if len(rows) >= k:
                    d = self.distances(rows, queries[q])
                    if len(rows) == n or np.partition(d, k - 1)[k - 1] <= radius[q]:
                        out[q] = (rows, d)
                        continue
                stay.append(q)
            lo[rest], hi[rest] = np.minimum(lo[rest], a), np.maximum(hi[rest], b)
            rest = np.array(stay, np.int64)
            radius[rest] *= GROWTH
        return out


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def _searcher(k: int, block: int):
    """A task: rows of a shard, its vectors before the queries."""

    def best(shards: dict[int, tuple[Shard, list[np.ndarray]]], keys: list[int], ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, float]] = []
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes).tolist():
            if dim not in shards:
                continue
            shard, names = shards[dim]
            mine = np.flatnonzero(sizes == dim).tolist()
            # A query may meet itself, so one vector more.
            for q, (rows, d) in zip(mine, shard.search(np.stack([vectors[q] for q in mine]), min(k + 1, len(names)))):
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                hits = sorted((float(d[j]), int(i)) for j in near.tolist() for i in names[rows[j]] if i != ids[q][0])
                out += [(keys[q], int(ids[q][0]), i, x) for x, i in hits[:k]]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["key", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        shards: dict[int, tuple[Shard, list[np.ndarray]]] | None = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            n = int((key < 0).sum())
            if n:
                held[0].extend(_lists(batch.column(1).slice(0, n)))
                held[1].extend(_lists(batch.column(2).slice(0, n)))
            if n < len(batch) and shards is None:
                sizes = np.array([len(v) for v in held[1]])
                groups = {d: np.flatnonzero(sizes == d).tolist() for d in np.unique(sizes).tolist()}
                shards = {d: (Shard(np.stack([held[1][i] for i in g])), [held[0][i] for i in g]) for d, g in groups.items()}
                held = ([], [])
            for i in range(n, len(batch), block):
                part = batch.slice(i, min(block, len(batch) - i))
                yield best(shards, part.column(0).to_pylist(), _lists(part.column(1)), _lists(part.column(2)))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by Euclidean distance in double precision."""
    spark = vectors.sparkSession
    workers.small_batches(spark)
    rows = valid_vectors(vectors, id_col, vector_col).dropDuplicates(["v", "vec_id"])
    # Equal vectors become one row with their k + 1 smallest ids: enough for any query, also one of them.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = scratch.written(rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = scratch.written(valid_vectors(queries, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "queries")
    n = distinct.count()
    shards = max(1, -(-n // shard), min(spark.sparkContext.defaultParallelism, n // LEAST))
    of = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    left = distinct.select(of.alias("shard"), F.lit(-1).cast("long").alias("key"), "ids", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "key", F.array("vec_id").alias("ids"), "v")
    streams = left.unionByName(right).repartitionById(shards, "shard").sortWithinPartitions("key").select("key", "ids", "v")
    found = streams.mapInArrow(workers.lean(_searcher(k, block)), "key long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, table.filter("vec_id % 100 = 0"))
