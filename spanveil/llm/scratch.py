"""Tables written in the shared folder of the cluster, and their removal.

Writing is one execution that nothing repeats, so its shuffle files go when it
ends.  Tables written inside ``clearing`` are deleted when it ends, but for
those written with ``stays``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from spanveil.sources.shared import fresh, root

__all__ = ["clearing", "dropped", "fresh", "root", "written"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """The same rows, read back from a new table in the shared folder: the lineage is cut there."""
    spark = df.sparkSession
    path = fresh(spark, name)
    if _open and not stays:
        _open[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanveil_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, [t._spanveil_path])


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        _delete(spark, mine)
