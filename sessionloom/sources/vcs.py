"""State of a Git working tree, read on the driver by commands that change nothing."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sessionloom.operators.relevance import classify_status

COMMANDS = {
    "branch": ["symbolic-ref", "--short", "-q", "HEAD"],
    "head": ["rev-parse", "--verify", "-q", "HEAD"],
    "head_subject": ["log", "-1", "--format=%s"],
    "status": ["status", "--porcelain=v1"],
    "diff_stat": ["diff", "--stat"],
    "changed": ["diff", "--name-status"],
    "staged_stat": ["diff", "--cached", "--stat"],
    "staged": ["diff", "--cached", "--name-status"],
    "commits": ["log", "-10", "--oneline", "--decorate"],
}


@dataclass
class Head:
    """One repository's state as text."""

    root: str = ""
    texts: dict[str, str] = field(default_factory=dict)

    @property
    def detached(self) -> bool:
        return bool(self.texts.get("head")) and not self.texts.get("branch")

    @property
    def dirty(self) -> bool:
        return bool(self.texts.get("status", "").strip())


def git(root: str, *args: str, timeout: int = 30) -> str | None:
    """A command's output without the newline at its end; null if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace").rstrip("\n") if done.returncode == 0 else None


def find_root(path: str) -> str | None:
    return git(path, "rev-parse", "--show-toplevel")


def collect(path: str) -> Head | None:
    root = find_root(path)
    if root is None:
        return None
    found = Head(root, {name: git(root, *args) or "" for name, args in COMMANDS.items()})
    if found.detached:
        found.texts["describe"] = git(root, "describe", "--all", "--always") or ""
    return found


def vcs_changes(spark: SparkSession, head: Head) -> DataFrame:
    """path, change_kind and pos of a tree's status."""
    rows = [(line, i) for i, line in enumerate(head.texts.get("status", "").split("\n"))]
    return classify_status(spark.createDataFrame(rows, "line string, pos long"))
