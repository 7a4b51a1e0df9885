"""Which sessions there are, and which one belongs to a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.classify import session_match
from sessionloom.functions.text import name_slug, path_slug


class NoSession(LookupError):
    """No session fits; the message says why."""


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def session_id_of_path(path: Column, agent: str) -> Column:
    """An id in the file's name: a UUID (rollout), eight hexadecimal digits at its end (patch), else its stem."""
    name = F.substring_index(path, "/", -1)
    pattern = {"rollout": r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", "patch": r"-([0-9a-fA-F]{8})\.jsonl?$"}.get(agent)
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), file_stem(path)) if pattern else file_stem(path)


def path_hint(path: Column, agent: str, root: str) -> Column:
    """Does the session's folder carry the repository's name? The rollout dialect's folders don't tell."""
    parts = F.split(path, "/")
    if agent == "block":
        return F.lower(F.element_at(parts, -2)) == F.lower(path_slug(F.lit(root)))
    if agent == "patch":
        slug = name_slug(F.lit(root.rstrip("/").rsplit("/", 1)[-1]))
        project = F.lower(F.try_element_at(parts, F.lit(-3)))
        return F.coalesce((project == slug) | project.startswith(F.concat(slug, F.lit("-"))), F.lit(False))
    return F.lit(False)


def newest(files: DataFrame, most: int) -> DataFrame:
    """The `most` files that changed last, ties by path: a top-k, so that no task ranks all files."""
    return files.orderBy(F.desc("mtime"), "session_key").limit(most)


def discover(files: DataFrame, probes: DataFrame, agent: str, root: str) -> DataFrame:
    """Sessions with agent, session_id, path, mtime, size, cwd, match and note.

    files: (session_key, mtime, size); probes: (session_key, session_id, cwd)
    of the files whose heads were read.
    """
    rows = files.join(probes.withColumnRenamed("session_id", "probed").withColumn("read", F.lit(True)), "session_key", "left")
    match = session_match(F.col("cwd"), F.lit(root), path_hint(F.col("session_key"), agent, root))
    rows = rows.withColumn("match", match).withColumn("session_id", F.coalesce("probed", session_id_of_path(F.col("session_key"), agent)))
    note = (
        F.when(F.col("match") == "confirmed", "its log names the repository's folder")
        .when(F.col("match") == "foreign", F.concat(F.lit("its log names another folder: "), F.col("cwd")))
        .when(F.col("match") == "hinted", "its folder carries the repository's name")
        .otherwise(F.when(F.col("read"), "its log's head names no folder").otherwise("its log was not read"))
    )
    return rows.select(F.lit(agent).alias("agent"), "session_id", F.col("session_key").alias("path"), "mtime", "size", "cwd", "match", note.alias("note"))


def newest_first(sessions: DataFrame) -> DataFrame:
    """Sessions by the time of their last change, the newest first, ties by path."""
    return sessions.orderBy(F.desc("mtime"), "path")


def ranked(sessions: DataFrame) -> DataFrame:
    """Sessions tied to the repository with their rank (0 confirmed, 1 hinted), best first, of equals the newest."""
    rank = F.when(F.col("match") == "confirmed", 0).when(F.col("match") == "hinted", 1)
    return sessions.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", F.desc("mtime"), "path")


def select_session(sessions: DataFrame, session_id: str | None = None) -> dict:
    """The newest session whose id begins with, or whose file name holds, `session_id`; else the newest confirmed, else hinted."""
    if session_id:
        wanted = session_id.lower()
        name = F.lower(F.substring_index("path", "/", -1))
        fits = sessions.where(F.lower("session_id").startswith(wanted) | name.contains(wanted))
        found = newest_first(fits).limit(1).collect()
        if not found:
            raise NoSession(f"no session '{session_id}'")
        return found[0].asDict()
    found = ranked(sessions).drop("rank").limit(1).collect()
    if found:
        return found[0].asDict()
    n, n_foreign = sessions.agg(F.count("*"), F.count_if(F.col("match") == "foreign")).first()
    if not n:
        raise NoSession("there are no sessions")
    raise NoSession(f"all {n} sessions belong to other folders" if n == n_foreign else "no session can be tied to the repository")


def linked_counts(sessions: DataFrame) -> DataFrame:
    """agent, sessions, and how many of them are confirmed or hinted."""
    return sessions.groupBy("agent").agg(F.count("*").alias("sessions"), F.count_if(F.col("match").isin("confirmed", "hinted")).alias("linked"))
