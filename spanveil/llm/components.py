"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node hang on the least of its neighbourhood; small star: those not above."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for every node of the links (u, v).

    Each round is written to the shared folder; the rounds needed grow with the
    logarithm of the longest path.  Self links are ignored.
    """
    now = scratch.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))).first()
        if tuple(sign) == mark:
            break
        mark = tuple(sign)
        after = scratch.written(_star(_star(now, True), False), "components")
        scratch.dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", F.col("v").alias("component")).distinct())
