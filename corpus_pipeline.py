"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns the columns of `documents`, but for the last, which returns tokens. A
row of `documents` is known by its doc_id; rows that share an id share a
stage's decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontam, quality, secrets, simhash
from sessionloom.llm.common import few_broadcast, remove, temporary


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in `ids`, a null id counting as a value; few ids are broadcast."""
    gone = few_broadcast(ids.select(F.col("doc_id").alias("__gone_id")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__gone_id")), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_verdict(docs, rules).where("__kept").drop("__kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component only the document of least id stays."""
    found = simhash.simhash_dedup(docs)
    stays = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return _without(docs, stays.where("NOT stays"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of `benchmark` go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars is the new length."""
    out = secrets.redact_secrets(docs, temporary(spark, "ledger"))
    return out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__cut")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests that show the round trip."""
    import public_tokenizers

    return bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the learned and hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on the table `documents`; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        place = temporary(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if before:
            remove(spark, before)
        before = place
    return docs
