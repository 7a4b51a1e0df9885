"""Reports kept under names that sort by time, each content once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from sessionloom.functions.text import safe_component, sha256_text, short_id
from sessionloom.shared import checkpointed

#: Digits of a hash that name its partition.
PREFIX = 2
NAME = r"^(\d{8}-\d{6})-([A-Za-z0-9._]+)-([A-Za-z0-9._-]+?)(?:-(\d+))?\.md$"


def archive_name(generated_at: Column, agent: Column, session_id: Column) -> Column:
    return F.concat_ws("-", F.date_format(generated_at, "yyyyMMdd-HHmmss"), safe_component(agent), F.concat(safe_component(short_id(session_id)), F.lit(".md")))


def not_archived(current: DataFrame, archive: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content no archived row has."""
    kept = archive.select(sha256_text(F.col(content)).alias("__hash")).distinct()
    return current.withColumn("__hash", sha256_text(F.col(content))).join(kept, "__hash", "left_anti").drop("__hash")


def hashed(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with the hash of their content, and its first two digits, by which an archive is partitioned."""
    rows = rows.withColumn("hash", sha256_text(F.col(content)))
    return rows.withColumn("prefix", F.left("hash", F.lit(PREFIX)))


def kept_hashes(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    """prefix and hash of what the archive at `path` has under these prefixes; no other partition and no content is read."""
    return spark.read.parquet(path).where(F.col("prefix").isin(prefixes)).select("prefix", "hash")


def append_new(current: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Appends to the archive at `path` what it lacks, and returns that.

    The archive is partitioned by the first digits of a stored hash: only the
    partitions that new rows fall into are read (at most 256, so their list is
    short), and of those only the hashes. A row whose content is null has the
    hash null, stands under its own partition, and is kept once.
    """
    spark = current.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    # the plan reads the archive, so it is fixed before the archive grows
    new = checkpointed(hashed(current, content).withColumns({"hash": F.coalesce("hash", F.lit("null")), "prefix": F.coalesce("prefix", F.lit("null"))}).dropDuplicates(["hash"]))
    if there:
        prefixes = [r["prefix"] for r in new.select("prefix").distinct().collect()]
        new = checkpointed(new.join(kept_hashes(spark, path, prefixes), ["prefix", "hash"], "left_anti"))
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    return new.drop("prefix", "hash")


def history(names: DataFrame, name: str = "name", most: int = 20) -> DataFrame:
    """The newest archived names, taken apart: generated, agent, session, copy."""
    parts = [F.regexp_extract(name, NAME, i).alias(n) for i, n in enumerate(("generated", "agent", "session", "copy"), 1)]
    return names.where(F.col(name).endswith(".md")).orderBy(F.desc(name)).limit(most).select(name, *parts)
