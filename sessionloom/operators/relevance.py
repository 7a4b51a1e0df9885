"""Version-control changes, and how they meet the files that a session touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.classify import vcs_kind
from sessionloom.functions.text import normalize_path

#: Kinds of change in the order in which they are listed.
KINDS = ("modified", "added", "renamed", "deleted", "conflicted", "untracked")


def classify_status(lines: DataFrame, line: str = "line", keys: list[str] | None = None) -> DataFrame:
    """path, change_kind and pos of status lines (`XY path`, a rename's new path); pos orders a repository's lines."""
    keys = keys or []
    rows = lines.where(F.length(line) >= 4)
    path = F.trim(F.substring(F.col(line), F.lit(4), F.length(line)))
    path = F.when(F.locate(" -> ", path) > 0, F.regexp_extract(path, r"^.*? -> (.*)$", 1)).otherwise(path)
    path = F.regexp_replace(path, '^"+|"+$', "")
    return rows.select(*keys, path.alias("path"), vcs_kind(F.left(line, F.lit(2))).alias("change_kind"), "pos")


def changed_paths(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each changed path once, with its place in the list of kinds, then of lines."""
    keys = keys or []
    group = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("change_kind"))
    place = F.struct(group.alias("grp"), F.col("pos").alias("pos"))
    return changes.groupBy(*keys, "path").agg(F.min(place).alias("place"), F.min_by("change_kind", place).alias("change_kind"))


def status_counts(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return changes.groupBy(*(keys or []), "change_kind").agg(F.count("*").alias("n"))


def relative_touched(touched: DataFrame, root: str) -> DataFrame:
    """(session_key, path, n) of touched files below `root`; other absolute paths go, the last count of a path stays."""
    base = normalize_path(F.lit(root))
    path = normalize_path(F.col("path"))
    rel = F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).when(~path.rlike("^([a-z]:)?/"), path)
    rows = touched.withColumn("path", rel).where(F.col("path").isNotNull())
    return rows.groupBy("session_key", "path").agg(F.max_by("n", "first").alias("n"))


def changed_with_touched(changed: DataFrame, touched: DataFrame, most: int | None = 60) -> DataFrame:
    """A session's changed paths in their order, each with whether the session touched it; `changed` has a session_key."""
    seen = touched.select(F.col("path").alias("key"), "session_key").distinct()
    rows = changed.withColumn("key", normalize_path(F.col("path")))
    out = rows.join(seen.withColumn("touched", F.lit(True)), ["session_key", "key"], "left").withColumn("touched", F.coalesce("touched", F.lit(False))).drop("key")
    if most is None:
        return out
    w = Window.partitionBy("session_key").orderBy("place")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def touched_but_clean(touched: DataFrame, changed: DataFrame, most: int | None = 20) -> DataFrame:
    """Touched paths that are not changed, in order of path."""
    keys = changed.select(normalize_path(F.col("path")).alias("path")).distinct()
    out = touched.join(keys, "path", "left_anti")
    if most is None:
        return out
    w = Window.partitionBy("session_key").orderBy("path")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
