"""Evidence and statistics of growing sessions, brought up to date from what was appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import Limits
from sessionloom.operators import block_log, evidence, rollout_log
from sessionloom.plans.snapshot import versions
from sessionloom.shared import checkpointed, remove
from sessionloom.sources.jsonl import parsed
from sessionloom.sources.ranges import read_ranges

#: Dialects whose logs only grow; one that rewinds is read anew.
GROWING = {"block": block_log, "rollout": rollout_log}
TABLES = ("offsets", "evidence", "counts", "bad", "users", "ids")


def refresh(spark: SparkSession, agent: str, files: DataFrame, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(selected events, statistics) of listed sessions (session_key, size), as `build_evidence` gives them.

    The state below `path` holds, for each session, how far it was read and what
    can be merged: its evidence, its counts, and (for the rollout dialect) the
    digests of its user messages and its first id. Only bytes from there on are
    read. A file that became shorter is read anew; one that is no longer listed
    goes. A last line without a line feed waits until it has one. Places are
    bytes: block_start is 0 and line_no the byte at which a line begins.

    Every call writes a version of its own and removes all but the one before;
    one that was not finished is passed over.
    """
    if agent not in GROWING:
        raise ValueError(f"the logs of {agent!r} don't only grow; there are {', '.join(GROWING)}")
    done = versions(spark, path, "offsets")
    old = {t: spark.read.parquet(f"{path}/version={done[-1]}/{t}") for t in TABLES} if done else None
    listed = files.select("session_key", "size")
    if old is None:
        todo = listed.withColumn("begin", F.lit(0).cast("long"))
        kept = None
    else:
        todo = listed.join(old["offsets"], "session_key", "left")
        todo = todo.withColumn("begin", F.when(F.col("size") >= F.col("offset"), F.col("offset")).otherwise(0).cast("long")).drop("offset")
        kept = checkpointed(todo.where("begin > 0").select("session_key"))
    todo = checkpointed(todo)
    raw = read_ranges(todo)
    lines = parsed(raw.drop("ends"))

    def before(name: str) -> DataFrame | None:
        return None if kept is None else old[name].join(kept, "session_key", "left_semi")

    def merged(name: str, new: DataFrame) -> DataFrame:
        return new if kept is None else before(name).select(new.columns).unionByName(new)

    users = ids = None
    if agent == "rollout":
        users, ids = rollout_log.user_digests(lines), rollout_log.first_ids(lines, before("ids"))
        events = rollout_log.normalize(lines, earlier=before("users"), named=before("ids"))
    else:
        events = GROWING[agent].normalize(lines)
    trimmed = evidence.trim(events, limits)
    number = done[-1] + 1 if done else 1
    place = f"{path}/version={number}"
    # the digest of a text is kept once, at its first place
    firsts = None if users is None else merged("users", users).groupBy("session_key", "digest").agg(F.min(F.struct("block_start", "line_no", "sub_no")).alias("at")).select("session_key", "at.*", "digest")
    nothing = {"users": "session_key string, block_start long, line_no long, sub_no int, digest string", "ids": "session_key string, first_id string, named_at struct<block_start:bigint,line_no:bigint>"}
    new = {
        "evidence": evidence.merge_buckets(merged("evidence", evidence.select_buckets(trimmed, limits)), limits),
        "counts": evidence.added_counts(merged("counts", evidence.session_counts(trimmed))),
        "bad": merged("bad", evidence.bad_lines(lines)).groupBy("session_key").agg(F.sum("invalid_lines").alias("invalid_lines")),
        "users": spark.createDataFrame([], nothing["users"]) if firsts is None else firsts,
        "ids": spark.createDataFrame([], nothing["ids"]) if ids is None else ids,
        "offsets": todo.join(raw.groupBy("session_key").agg(F.max("ends").alias("ends")), "session_key", "left").select("session_key", F.coalesce("ends", "begin").alias("offset")),
    }
    for name, table in new.items():  # offsets last: a version is finished by them
        table.write.mode("overwrite").parquet(f"{place}/{name}")
    for gone in done[:-1]:
        remove(spark, f"{path}/version={gone}")
    have = {t: spark.read.parquet(f"{place}/{t}") for t in TABLES}
    return have["evidence"], evidence.stats_of(have["counts"], have["bad"])
