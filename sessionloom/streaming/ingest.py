"""Incremental ingest of growing session folders. The batch operators have no counterpart of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.plans.snapshot import normalize
from sessionloom.sources.jsonl import parsed


def stream_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", max_files: int = 1000) -> DataFrame:
    """Lines of files as they appear below `root`; each batch is parsed and numbered on its own."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    raw = reader.load(root)
    rows = raw.select(F.col("_metadata.file_path").alias("session_key"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line"))
    return rows


def ingest(spark: SparkSession, root: str, agent: str, table_path: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends the events of new files to a Parquet table; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        lines = parsed(batch.withColumn("line_no", F.monotonically_increasing_id()))
        events = normalize(lines, agent)
        # one folder a batch: a replay after a failure overwrites it, so each event is stored once
        events.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        if on_batch is not None:
            on_batch(spark.read.parquet(f"{table_path}/batch={number}"))

    rows = stream_lines(spark, root)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows of their time, closed `late` after the newest; for streams and tables alike."""
    rows = events.where(F.col("ts").isNotNull())
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
