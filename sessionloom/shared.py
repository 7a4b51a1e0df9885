"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys up to which they are broadcast.
FEW_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent and all runs on one machine is a folder
    made; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sessionloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def temporary(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which the driver removes when it ends."""
    path = f"{shared_dir(spark)}/sessionloom/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_broadcast(df: DataFrame) -> DataFrame:
    """`df`, written, with the hint to broadcast it if it has at most `FEW_ROWS` rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    It matters where the driver was started in another folder; a cluster whose
    nodes lack the package gets it by spark.submit.pyFiles.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
