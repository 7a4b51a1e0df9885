"""The plans a user calls: read sessions, normalise, select evidence, and report."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import Limits, load_config
from sessionloom.operators import block_log, discovery, evidence, patch_log, relevance, rollout_log
from sessionloom.plans import render
from sessionloom.shared import checkpointed, remove
from sessionloom.sources import heads, jsonl, vcs
from sessionloom.sources.files import archive_path, digests, exact_path, file_listing, memory_index, plain_path, sha256_file, write_atomic

DIALECTS = {"block": block_log, "rollout": rollout_log, "patch": patch_log}


def read_transcripts(spark: SparkSession, agent: str, root: str) -> DataFrame:
    """All sessions of a dialect below its root, as parsed lines."""
    if agent == "rollout":
        return jsonl.read_rollout(spark, root)
    return jsonl.read_jsonl(spark, {"block": jsonl.block_log_files, "patch": jsonl.patch_log_files}[agent](root))


def normalize(lines: DataFrame, agent: str) -> DataFrame:
    """Parsed lines as events; an unknown dialect is an error."""
    if agent not in DIALECTS:
        raise ValueError(f"unknown dialect {agent!r}; there are {', '.join(DIALECTS)}")
    return DIALECTS[agent].normalize(lines)


def all_events(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Events of several dialects, each from its root, in one table."""
    out = None
    for agent, root in roots.items():
        part = normalize(read_transcripts(spark, agent, root), agent)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no roots")
    return out


def build_evidence(events: DataFrame, lines: DataFrame | None = None, limits: Limits = Limits(), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selected events in their buckets, one row of statistics for each session); `strict` as in `evidence.trim`."""
    trimmed = evidence.trim(events, limits, strict)
    return evidence.select_buckets(trimmed, limits), evidence.session_stats(trimmed, lines)


def project_markers(files: DataFrame) -> DataFrame:
    """(project, cwd) of the marker files that stand beside the chats of `files`, read as heads are."""
    # names with a dot are passed over by file listings, so markers are opened by their full paths
    project = F.regexp_extract("session_key", "^(.*)/[^/]+/[^/]+$", 1)
    places = files.select(project.alias("project")).distinct().select(F.concat("project", F.lit("/.project_root")).alias("session_key"))
    said = heads.read_head_lines(places, *patch_log.HEAD).groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("cwd"))
    return said.select(F.regexp_replace(F.regexp_replace("session_key", "/[^/]+$", ""), "^file:/+", "/").alias("project"), "cwd")


def session_files(spark: SparkSession, agent: str, root: str) -> DataFrame:
    """session_key, mtime and size of a dialect's files below its root; no file is opened."""
    found = None
    for path, recursive, pattern in jsonl.places(agent, root):
        found = file_listing(spark, path, pattern, recursive)
        if not found.isEmpty():
            break
    return found


def probe_files(spark: SparkSession, agent: str, root: str, files: DataFrame) -> DataFrame:
    """session_key, session_id and cwd of listed files, of which only the heads are read.

    On a file system that only Spark can open, whole sessions are read instead.
    """
    if heads.reachable(spark, root):
        lines = heads.read_heads(files, *DIALECTS[agent].HEAD)
        return patch_log.probe(lines, project_markers(files)) if agent == "patch" else DIALECTS[agent].probe(lines)
    lines = read_transcripts(spark, agent, root)
    return DIALECTS[agent].probe(lines).join(files.select("session_key"), "session_key", "left_semi")


def discover_sessions(spark: SparkSession, agent: str, root: str, repo: str, probe_limit: int | None = None, catalogue: str | None = None) -> DataFrame:
    """Sessions of a dialect and how each belongs to `repo`.

    Files are listed, not read; then the heads of all are probed, or only those
    of the `probe_limit` newest. With a `catalogue` (see `update_catalogue`)
    only files that it does not know as they are now are probed.
    """
    files = session_files(spark, agent, root)
    if catalogue is not None:
        known = update_catalogue(spark, agent, root, files, catalogue)
        return discovery.discover(files, known.select("session_key", "session_id", "cwd"), agent, repo)
    chosen = files if probe_limit is None else discovery.newest(files, probe_limit)
    return discovery.discover(files, probe_files(spark, agent, root, chosen), agent, repo)


def update_catalogue(spark: SparkSession, agent: str, root: str, files: DataFrame, path: str) -> DataFrame:
    """What is known of each listed file: agent, session_key, mtime, size, session_id and cwd.

    A file whose path, time and size the catalogue has is not opened again; new
    and changed ones are probed, and those that are gone are left out. Each call
    writes a version of its own below `path`, and drops all but the one before,
    which a reader may still hold. A version that was not written to its end is
    passed over.
    """
    place = f"{path}/{agent}"
    done = versions(spark, place)
    key = ["session_key", "mtime", "size"]
    fresh = files
    kept = None
    if done:
        kept = spark.read.parquet(f"{place}/version={done[-1]}").join(files, key, "left_semi")
        fresh = files.join(spark.read.parquet(f"{place}/version={done[-1]}").select(*key), key, "left_anti")
    # the listing of what is to be opened is fixed, since it is read twice
    fresh = checkpointed(fresh)
    found = fresh.join(probe_files(spark, agent, root, fresh), "session_key", "left").select(F.lit(agent).alias("agent"), *key, "session_id", "cwd")
    new = found if kept is None else kept.select(found.columns).unionByName(found)
    number = done[-1] + 1 if done else 1
    new.write.mode("overwrite").parquet(f"{place}/version={number}")
    for old in done[:-1]:
        remove(spark, f"{place}/version={old}")
    return spark.read.parquet(f"{place}/version={number}")


def versions(spark: SparkSession, place: str, table: str | None = None) -> list[int]:
    """Numbers of the versions below `place` that were written to their end; of several tables, `table` is the last."""
    found = spark._jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (place, "version=*", table, "_SUCCESS"))))
    done = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    names = (f.getPath().getParent() for f in done or [])
    return sorted(int((p.getParent() if table else p).getName().split("=")[1]) for p in names)


def source_digest(spark: SparkSession, path: str) -> str | None:
    """The digest of a session's file, read in pieces by a task; null if it is gone, or only Spark can open it."""
    if not heads.reachable(spark, path):
        return None
    return digests(spark.createDataFrame([(path,)], "session_key string")).first()["sha256"]


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of one session; the reader is given its file alone."""
    return jsonl.read_jsonl(spark, exact_path(path))


def explicit_session(spark: SparkSession, agent: str, path: str) -> dict:
    """A session chosen by its file, whichever folder it belongs to; an error if there is none."""
    local = plain_path(path)
    files = file_listing(spark, exact_path(path)) if available(spark, local) else None
    if files is None or files.isEmpty():
        raise discovery.NoSession(f"there is no session file {path}")
    row = discovery.discover(files, probe_files(spark, agent, local, files), agent, "").first().asDict()
    return row | {"match": "explicit", "note": "chosen by its file"}


def relevant_files(changed: DataFrame, touched: DataFrame, root: str, session_key: str) -> list[str]:
    """Lines of a report: changed files and whether the session touched them, then touched files that are clean."""
    rel = relevance.relative_touched(touched.where(F.col("session_key") == session_key), root)
    own = relevance.changed_paths(changed).withColumn("session_key", F.lit(session_key))
    out = [f"- `{r['path']}`" + (" - touched by the session" if r["touched"] else "") for r in relevance.changed_with_touched(own, rel).orderBy("rank").collect()]
    return out + [f"- `{r['path']}` - touched by the session, clean now" for r in relevance.touched_but_clean(rel, own).orderBy("rank").collect()]


def _choose(spark: SparkSession, agent: str, root: str, repo: str, session_id: str | None, session_file: str | None, catalogue: str | None) -> dict:
    if session_file:
        return explicit_session(spark, agent, session_file)
    return discovery.select_session(discover_sessions(spark, agent, root, repo, catalogue=catalogue), session_id)


def snapshot(spark: SparkSession, agent: str, root: str, repo: str, out: str, session_id: str | None = None, config: str | None = None, session_file: str | None = None, catalogue: str | None = None) -> dict[str, str]:
    """Selects a session of `repo`, writes its evidence, facts, prompt and report below `out`, and returns their paths.

    An explicit `session_file` wins over `session_id`, and that over the newest
    session of the repository. Of all transcripts only the chosen one is read
    whole; its evidence and statistics are kept as tables in `out`/tables.
    """
    return _snapshot(spark, agent, repo, out, _choose(spark, agent, root, repo, session_id, session_file, catalogue), config)


def _snapshot(spark: SparkSession, agent: str, repo: str, out: str, session: dict, config: str | None) -> dict[str, str]:
    settings = load_config(config)
    lines = read_session(spark, session["path"])
    events = normalize(lines, agent)
    selected, stats = build_evidence(events, lines, Limits.of(settings))
    save(selected, stats, f"{out}/tables", evidence.touched_files(events))
    if spark.read.parquet(f"{out}/tables/session_stats").isEmpty():
        raise discovery.NoSession(f"{session['path']} has no events")
    return _report(spark, repo, out, session, settings)


def _report(spark: SparkSession, repo: str, out: str, session: dict, settings: dict) -> dict[str, str]:
    """All texts of a session from its saved tables and the repository's present state."""
    now = datetime.now(timezone.utc).replace(microsecond=0).isoformat()
    selected, stats, touched = (spark.read.parquet(f"{out}/tables/{n}") for n in ("evidence", "session_stats", "touched"))
    found = stats.where(F.col("session_key") == session["path"]).first()
    buckets = render.collect_buckets(selected, session["path"])
    n_selected = len({(e["block_start"], e["line_no"], e["sub_no"]) for rows in buckets.values() for e in rows})
    head = vcs.collect(repo) or vcs.Head(repo)
    relevant = relevant_files(vcs.vcs_changes(spark, head), touched, head.root, session["path"])
    memory = render.render_memory(memory_index(spark, [(session["agent"], "Project instructions", os.path.join(repo, n)) for n in ("AGENTS.md",)]).collect())
    state, told = render.render_vcs(head, now), render.render_evidence(session, found, buckets, now)
    texts = {
        "evidence.md": told,
        "session.json": render.session_meta(session, found, n_selected, {"root": head.root, **head.texts}, now, source_digest(spark, session["path"]) or session.get("source_sha256")),
        "git-state.txt": state,
        "prompt.md": render.render_prompt(spark, session, found, n_selected, head, state, told, int(settings["llm"].get("max_input_chars") or 120_000)),
        "report.md": render.render_report(session, found, buckets, relevant, memory, now, head),
    }
    os.makedirs(out, exist_ok=True)
    for name, text in texts.items():
        write_atomic(os.path.join(out, name), text)
    return {name: os.path.join(out, name) for name in texts}


def preserve(out: str, name: str, agent: str, session_id: str, generated_at: datetime) -> str | None:
    """Copies a report into the history unless a report of equal content is there; returns the copy's path."""
    current, folder = os.path.join(out, name), os.path.join(out, "history")
    if not os.path.isfile(current):
        return None
    os.makedirs(folder, exist_ok=True)
    # only files of equal size can be equal
    digest, size = sha256_file(current), os.path.getsize(current)
    kept = (os.path.join(folder, f) for f in os.listdir(folder))
    if any(os.path.getsize(f) == size and sha256_file(f) == digest for f in kept):
        return None
    safe = [re.sub(r"[^A-Za-z0-9._-]+", "_", p or "").strip("_") or "unknown" for p in (agent, (session_id or "unknown")[:8])]
    path = archive_path(folder, f"{generated_at:%Y%m%d-%H%M%S}-{safe[0]}-{safe[1]}.md")
    with open(current, encoding="utf-8") as f:
        write_atomic(path, f.read())
    return path


def save(selected: DataFrame, stats: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """Evidence, statistics and touched files as tables, from which reports can be made anew without the transcripts."""
    for name, table in (("evidence", selected), ("session_stats", stats), ("touched", touched)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def rebuild(spark: SparkSession, repo: str, out: str, config: str | None = None) -> dict[str, str]:
    """The texts below `out` anew from the tables of the last snapshot and the repository's present state.

    No transcript is read, and it may be gone; the report that is there goes to
    the history first. An error if there was no snapshot.
    """
    known = show(out, "session.json")
    if known is None:
        raise discovery.NoSession(f"there is no snapshot in {out}; make one first")
    meta = json.loads(known)
    session = {k: meta.get(of) for k, of in {"agent": "agent", "session_id": "session_id", "path": "source_path", "size": "source_size", "mtime": "source_mtime", "cwd": "session_cwd", "source_sha256": "source_sha256"}.items()}
    preserve(out, "report.md", session["agent"], session["session_id"], datetime.now(timezone.utc))
    return _report(spark, repo, out, session | {"match": "from snapshot"}, load_config(config))


def consolidate(spark: SparkSession, path: str, changed: DataFrame, session_key: str | None = None) -> DataFrame:
    """Saved statistics joined with fresh changes: a row for each session with the number of changes of each kind."""
    stats = spark.read.parquet(f"{path}/session_stats")
    if session_key:
        stats = stats.where(F.col("session_key") == session_key)
    rows = {r["change_kind"]: r["n"] for r in relevance.status_counts(changed).collect()}  # six kinds at most
    changes = F.array(*[F.struct(F.lit(k).alias("change_kind"), F.lit(n).alias("n")) for k, n in sorted(rows.items())])
    return stats.withColumn("changes", changes)


def status(spark: SparkSession, roots: dict[str, str], repo: str, probe_limit: int = 20) -> DataFrame:
    """The newest session of each dialect that is tied to `repo`."""
    out = None
    for agent, root in roots.items():
        part = discover_sessions(spark, agent, root, repo, probe_limit).where(F.col("match").isin("confirmed", "hinted"))
        part = discovery.newest_first(part).limit(1)
        out = part if out is None else out.unionByName(part)
    return out


def show(out: str, name: str = "report.md") -> str | None:
    """The last report written below `out`; null if there is none."""
    path = os.path.join(out, name)
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def recover(spark: SparkSession, agent: str, root: str, repo: str, out: str, session_id: str | None = None, config: str | None = None, session_file: str | None = None, catalogue: str | None = None) -> dict[str, str]:
    """Keeps the report that is there in the history, then writes a new one from the session's transcript."""
    session = _choose(spark, agent, root, repo, session_id, session_file, catalogue)
    preserve(out, "report.md", agent, session["session_id"], datetime.now(timezone.utc))
    return _snapshot(spark, agent, repo, out, session, config)


def available(spark: SparkSession, root: str) -> bool:
    """Is there a folder at `root`, on whatever file system it names?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def doctor(spark: SparkSession, roots: dict[str, str], repo: str) -> DataFrame:
    """Sessions and linked sessions of each dialect whose root is there."""
    out = None
    for agent, root in roots.items():
        if available(spark, root):
            part = discovery.linked_counts(discover_sessions(spark, agent, root, repo))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "agent string, sessions long, linked long")
