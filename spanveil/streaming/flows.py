"""Structured Streaming: documents and events as they arrive.  Batch functions do the work of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.sources import shared


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, in the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there, then stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", shared.fresh(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows of a stream's result: of the last batch for complete, of all batches else."""
    spark, path = stream.sparkSession, shared.fresh(stream.sparkSession, name)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared.fresh(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def one_run_at_a_time(requests: DataFrame, within: str = "1 hour") -> DataFrame:
    """At most one request of a key in the watermark's span."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def growing_glossary(stream: DataFrame, detections_of: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Aliases for what arrives: each batch numbers its new keys after the project's largest number so far.

    A batch writes its own folder, so a repeated batch gives the same aliases.
    """
    from spanveil.operators import glossary

    spark = stream.sparkSession

    def grow(batch: DataFrame, number: int) -> None:
        old = None
        for i in range(number):
            part = spark.read.parquet(f"{path}/batch={i}")
            old = part if old is None else old.unionByName(part)
        fresh = glossary.build(detections_of(batch))
        if old is not None:
            fresh = fresh.join(old.select("project_id", "category", "norm_key"), ["project_id", "category", "norm_key"], "left_anti")
            last = old.groupBy("project_id", "category").agg(F.max("number").alias("last"))
            fresh = glossary.numbered(fresh.drop("number", "alias"), ["project_id", "category"], "first_doc_seq", [F.col("first_start").desc(), F.col("norm_key")]).join(last, ["project_id", "category"], "left")
            fresh = fresh.withColumn("number", F.col("number") + F.coalesce("last", F.lit(0))).drop("last").withColumn("alias", F.format_string("%s_%03d", glossary.prefix(F.col("category")), F.col("number").cast("int")))
        fresh.select("project_id", "category", "norm_key", "alias", "number", "occurrences").write.mode("overwrite").parquet(f"{path}/batch={number}")

    drained(stream, grow)


def published(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> None:
    """Each micro-batch to every handler's own folder; a handler that fails leaves the others' results and an error row."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        errors = []
        for name, handler in handlers.items():
            try:
                handler(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            except Exception as x:  # isolated by contract; the error is kept as a row
                errors.append((name, number, type(x).__name__))
        if errors:
            batch.sparkSession.createDataFrame(errors, "handler string, batch long, error string").write.mode("overwrite").parquet(f"{path}/_errors/batch={number}")
        batch.unpersist()

    drained(stream, handle)
