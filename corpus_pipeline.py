"""From documents to token files: five stages, each written as Parquet and read again by the next.

``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents``.  All but
the last stage return the columns of documents.  No SQL gives these rows
(scores, tokens and files are beyond it), so ``ORACLE_SQL`` is None and tests
hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontaminate, mixing, nearcopies, scratch, tokenfiles, toxicity, workers

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def begun_afresh(stage: Stage) -> Stage:
    """Before the stage the executors give back what the stages before it have grown."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workers.rested(spark)
        return stage(spark, docs, sf_dir)

    return run


@begun_afresh
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5 go; null and empty texts have the score of no evidence and stay, repeated rows fare alike."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = {c: f"_doc_{c}" for c in docs.columns if c in ("score", "neighbours")}
    kept = toxicity.scored(docs.withColumnsRenamed(clash), model, evidence=False).filter("score < 0.5")
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


@begun_afresh
def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-gram Jaccard 0.8 or SimHash) one row stays.

    It is that of the smallest id, ids before null; among rows of that id the
    least by a hash of all columns.  So rows with unrelated texts stay whatever
    their ids, null texts are copies of the empty text, of wholly equal rows one
    stays, ties are broken alike in every run, and an empty table stays empty.
    """
    every = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(k), *every) for k in ("_key1", "_key2")})
    with scratch.clearing(spark):
        marked = nearcopies.near_copies(keyed, carry=("_key1", "_key2"))
        kept = marked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key1", "_key2")).alias("k")).select("k._key1", "k._key2")
        kept = scratch.written(kept, "near-duplicates", stays=True)
    return keyed.join(kept, ["_key1", "_key2"]).dropDuplicates(["_key1", "_key2"]).select(*docs.columns)


@begun_afresh
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut out of the texts, of very long ones too; documents of nothing else go; null and empty texts stay."""
    cut = decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


@begun_afresh
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it; texts without words take nothing of the budget and stay or go with their source's whole passes."""
    mixed = mixing.mixed(docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns if c in mixing.ADDED})).filter("copies > 0")
    copied = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copied.select(*[F.col(f"_doc_{c}").alias(c) if c in mixing.ADDED else F.col(c) for c in docs.columns])


@begun_afresh
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    import public_tokenizers

    return tokenfiles.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
