"""Tables in the shared folder that the cluster names in spark.checkpoint.dir.

Writing a table cuts the lineage: its files outlive the executors that made
them.  Where the setting is absent and the session is local, as in tests, a
temporary folder of this machine takes its place; elsewhere that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spanveil-")
    return f"file://{_local[app]}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/spanveil-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a new table in the shared folder."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
