"""What the corpus operators share: the shared folder, sizing and row access."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.shared import checkpointed, importable, remove, shared_dir, temporary

__all__ = ["checkpointed", "few_broadcast", "importable", "join_to_one", "keyed_text", "release_memory", "remove", "shard_count", "shared_dir", "shuffle_partitions", "slices", "stored", "temporary", "text_bytes"]

#: Rows of one key from which on a join broadcasts what the key meets, and keys that it does so for at most, the heaviest.
HOT_ROWS = 1_000
HOT_KEYS = 10_000
#: Rows of ids up to which they are broadcast.
FEW_ROWS = 500_000
#: Rows that a Python step turns into objects at once.
SLICE = 256


def join_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left and right joined by `key`, of which `right` has at most one row a value.

    Rows of `left` with a heavy key stay where they are and meet a broadcast of
    at most `HOT_KEYS` rows of `right`; the others are shuffled. `left` is read
    twice more, so it should be a stored table.
    """
    heavy = left.groupBy(key).count().where(F.col("count") > HOT_ROWS).orderBy(F.desc("count"), key).limit(HOT_KEYS)
    keys = [(r[0],) for r in heavy.select(key).collect()]
    if not keys:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(keys, T.StructType([left.schema[key]])))
    met = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(met, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """`df` as a Parquet table of its own in the shared folder."""
    place = temporary(df.sparkSession, kind)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def few_broadcast(df: DataFrame) -> DataFrame:
    """`df`, checkpointed, with the hint to broadcast it if it has at most `FEW_ROWS` rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of text in all rows: one scan with a partial sum per task."""
    row = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()
    return int(row["n"] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_count(spark: SparkSession, total: int, target: int) -> int:
    """So many shards that each holds about `target` bytes, and every shuffle partition has work."""
    return max(shuffle_partitions(spark), math.ceil(total / target), 1)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under fixed names: other columns cannot clash."""
    importable(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut small; at a partition's end the worker's freed memory goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    release_memory()


def release_memory() -> None:
    """Gives a worker's freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
