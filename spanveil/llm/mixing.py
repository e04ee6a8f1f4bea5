"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source whose target is
``e`` whole passes and a rest takes each document ``e`` times; the rest is a
subset sum over its lengths: a proportional share of every length first, then
single documents in seeded order, and at last a bounded-knapsack dynamic
programme over the lengths still free, which fits the remaining budget as
closely as sums of lengths allow.  The documents of a length are then selected
by a seeded hash.

The programme's table has one entry for each sum, of the free lengths' greatest
common divisor, up to ``TABLE`` words or ``WIDE`` times the longest free length,
whichever is more; so every length takes part, and a source whose budget is
below that is fitted exactly.

Scale: texts are read once; sizes and keys are written and everything after
works on those.  Targets come from running sums over one row per source.  A
fitting task holds one row per length of its source.  Of a length that is taken
in part, documents are counted in buckets of the hash; only the bucket in which
the selection ends is looked into, so no task sees a whole hot group.

Defined cases: null and empty texts have size 0 and take 0 words; very long
texts are counted whole; a null source is a source of its own that sorts last;
sources of size 0 have target 0; rows that share an id, or have none, are told
apart by a hash of their text, then of their other columns, so reruns agree
whatever the partitions; wholly equal rows are documents of their own, of which
as many are taken as the mix asks for; an empty table gives an empty result;
columns named like those of the mix give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm import scratch, workers

MAX_REPEATS = 3
TABLE, WIDE = 1 << 20, 4
#: Documents of one source and length in a bucket, on average.
BUCKET = 4096
#: The rows of one source and length are broadcast up to so many bytes, each with the source's name and ROW bytes; beyond that documents are shuffled to them.
BROADCAST, ROW = 32 << 20, 192
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, seed: int = SEED, table: int = TABLE, share: bool = True) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum up close to the budget, never above it."""
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.astype(np.int64)
    take = np.floor(counts * (budget / total * share)).astype(np.int64)
    left = int(budget) - int((take * lengths).sum())
    order = np.random.default_rng(seed).permutation(np.flatnonzero((lengths > 0) & (counts > 0))).tolist()
    longest = int(lengths[order].max())
    # The last words are fitted with room for any length: some of the share is given back for that.
    for i in order:
        if left >= min(2 * longest, int(budget)):
            break
        n = min(int(take[i]), -(-(2 * longest - left) // int(lengths[i])))
        take[i] -= n
        left += n * int(lengths[i])
    capacity = max(table, WIDE * longest)
    for i in order:
        n = min(int(counts[i] - take[i]), (left - capacity) // int(lengths[i]))
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    free = [i for i in order if counts[i] > take[i] and lengths[i] <= left]
    if free:
        _fill(take, lengths, counts, left, free)
    if share and int((take * lengths).sum()) < int(budget) <= capacity:
        # The share left no exact fit: the table holds the whole budget, so all subsets are tried.
        bare = fit(lengths, counts, budget, seed, table, False)
        return bare if (bare * lengths).sum() > (take * lengths).sum() else take
    return take


def _fill(take: np.ndarray, lengths: np.ndarray, counts: np.ndarray, left: int, free: list[int]) -> None:
    """Bounded knapsack: add documents of the free lengths to take, the greatest sum within ``left``."""
    unit = int(np.gcd.reduce(lengths[free]))
    room = left // unit
    # The sums reached so far are the bits of an integer; beside it stands the item that first reached each sum.
    items, reach, mask = [], 1, (1 << (room + 1)) - 1
    by = np.full(room + 1, -1, np.int32)
    for i in free:
        size, n, k = int(lengths[i]) // unit, int(counts[i] - take[i]), 1
        n = min(n, room // size)
        while n > 0:
            k = min(k, n)
            new = (reach << (k * size)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little", count=room + 1)
                by[np.flatnonzero(bits)] = len(items)
                items.append((i, k))
                reach |= new
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(lengths[i]) // unit


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in their order, repeating; whole numbers."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = MAX_REPEATS
    seed: int = SEED


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """_source, source_size and target: shares of all sizes by weight, stopped at cap times the size, the excess shared anew.

    A source is stopped if its share of what sources of a smaller size by
    weight leave over would exceed its cap, so running sums in that order tell.
    """
    place = F.row_number().over(Window.orderBy(F.col("_source") == "0", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (place % len(mix.weights) + 1).cast("int")).cast("long")
    rows = sources.withColumn("w", F.when(F.col("source_size") > 0, weight).otherwise(0)).withColumn("most", F.col("source_size") * mix.cap)
    by = Window.orderBy(F.expr("try_divide(source_size, w)").asc_nulls_last(), "_source")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("over", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumn("free", (F.col("w") > 0) & (exact("most") * exact("over") >= exact("w") * exact("left")))
    level = F.first(F.when(F.col("free"), F.struct("left", "over")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    share = F.col("level.left").cast("double") * F.col("w") / F.col("level.over")
    return rows.select("_source", "source_size", F.when(F.col("free"), share).otherwise(F.col("most").cast("double")).alias("target"))


def _kth(rows: DataFrame, by: list[str], key: list[str], rest: str) -> DataFrame:
    """by, key and what is left of ``rest`` there: the key at which the counts of its rows, in order, reach ``rest``."""
    counts = rows.groupBy(*by, *key, rest).agg(F.count(F.lit(1)).alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy(*key)))
    return upto.filter((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("m") < F.col(rest))).select(*by, *key, (F.col(rest) - F.col("upto") + F.col("m")).alias(rest))


def mixed(documents: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """The rows of documents, or of them the columns named, with size, source_size, target, copies (0 to cap) and taken (copies times size) added."""
    workers.small_batches(documents.sparkSession)
    keep = [c for c in (columns or documents.columns) if c not in ADDED]
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    # A key without nulls: "1" and the source, or "0" for null.
    key = F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))
    others = [x for c in documents.columns if c not in (id_col, text_col) for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    order = {"_o1": F.xxhash64(F.lit(mix.seed), F.col(id_col).cast("string")), "_o2": F.xxhash64(F.lit(mix.seed), text), "_o3": F.xxhash64(F.lit(mix.seed), *others)}
    sized = documents.select(*keep, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_source"), *[v.alias(k) for k, v in order.items()])
    sized = scratch.written(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    group = ["_source", "size"]
    narrow = sized.select(*group, *order, "_row")
    histogram = scratch.written(narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    aims = targets(histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), mix)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        total, goal = int(pdf["source_size"].iat[0]), float(pdf["target"].iat[0])
        base = min(int(goal // total), mix.cap) if total else 0
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        extra = np.zeros(len(pdf), np.int64)
        if base < mix.cap and total:
            # One more copy of some documents; where these cannot fill the budget, further copies up to the cap.
            extra = fit(size, n, goal - base * total, mix.seed)
            left = goal - base * total - int((extra * size).sum())
            if base + 1 < mix.cap and left >= 1:
                extra = extra + fit(size, np.where(size > 0, n * (mix.cap - base) - extra, 0), left, mix.seed)
            # A document that overshoots by less than what is missing comes nearer.
            left = goal - base * total - int((extra * size).sum())
            gain = np.where((n * (mix.cap - base) > extra) & (size > 0), left - np.abs(left - size), 0)
            if gain.max() > 0:
                extra[gain.argmax()] += 1
        return pdf[["_source", "size", "n", "source_size", "target"]].assign(base=(base + extra // n).astype(np.int32), extra=extra % n)

    planned = scratch.written(histogram.join(aims, "_source").groupBy("_source").applyInPandas(plan, "_source string, size long, n long, source_size long, target double, base int, extra long"), "mix-plan")
    planned = planned.withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    # Where a length is taken in part: the bucket, the key in it, the block of rows and the row with which the selection ends.
    bucket = F.pmod(F.xxhash64(*order), F.col("buckets")).alias("bucket")
    part = planned.filter("extra > 0").select(*group, "buckets", F.col("extra").alias("rest"))
    inside = narrow.join(part, group).select(*group, *order, "_row", bucket, "rest")
    last = scratch.written(_kth(inside, group, ["bucket"], "rest"), "mix-buckets")
    inside = scratch.written(inside.drop("rest").join(last, [*group, "bucket"]), "mix-last")
    tied = inside.drop("rest").join(_kth(inside, group, list(order), "rest"), [*group, *order]).withColumn("block", F.shiftright("_row", 33))
    tied = tied.drop("rest").join(_kth(tied, group, ["block"], "rest"), [*group, "block"])
    ends = tied.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_row"))).filter("place = rest").select(*group, F.struct("bucket", *order, "_row").alias("end"))
    ended = scratch.written(planned.join(ends, group, "left").select(*group, "source_size", "target", "base", "buckets", "end"), "mix-ends")
    more = F.coalesce(F.struct(bucket, *order, "_row") <= F.col("end"), F.lit(False)).cast("int")
    copies = F.col("base") + F.when(F.col("end").isNull(), 0).otherwise(more)
    held = ended.agg(F.coalesce(F.sum(F.octet_length("_source") + ROW), F.lit(0))).first()[0]
    return sized.join(F.broadcast(ended) if held <= BROADCAST else ended, group).select(*keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(documents, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
