"""Classifiers of messages, tools, outputs and paths, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.text import normalize_path, path_is_within, strip

# The names, key words, hints and patterns that decide a class.
MUTATING_NAMES = (
    "write", "edit", "multiedit", "notebookedit", "create", "delete",
    "str_replace_editor", "str_replace_based_edit_tool", "apply_patch",
    "patch", "update_file", "write_file", "edit_file", "filechange",
)
MUTATION_KEYWORDS = ("write", "edit", "patch", "create", "delete", "replace")
SHELL_WRITES = ("apply_patch", "set-content", "out-file", ">>", "add-content")
SHELL_TOOLS = ("run_shell_command", "execute_command", "shell")
CREDENTIAL_HINTS = (
    ".credentials.json", "auth.json", ".env", "id_rsa", "id_ed25519",
    ".pem", ".p12", ".pfx", ".netrc", ".npmrc", ".pgpass", "credentials",
)
INJECTED_ELEMENT = r"(?is)<([a-z][a-z0-9_\-]{2,40})(?:\s[^>]*)?>.*?</\1>"
INJECTED_PROBE = 20000
INJECTED_RESIDUE = 40
FAILURES = (
    r'"exit_code"\s*:\s*[1-9]',
    r"(?im)^\s*(exit code|exit status)\s*[:=]?\s*[1-9]",
    r"(?i)\b(traceback \(most recent call last\)|fatal error|command failed)\b",
)
#: Lower-case texts of which every match of a failure pattern has one: a cheap test before the pattern.
FAILURE_NEEDS = (('"exit_code"',), ("exit code", "exit status"), ("traceback (most recent call last)", "fatal error", "command failed"))


def is_injected_context(c: Column) -> Column:
    """Text that begins with `<` and has almost nothing outside complete elements: no one typed it."""
    text = strip(F.coalesce(c, F.lit("")))
    residue = F.regexp_replace(F.left(text, F.lit(INJECTED_PROBE)), INJECTED_ELEMENT, "")
    return F.when(text.startswith("<"), F.length(strip(residue)) < INJECTED_RESIDUE).otherwise(False)


def is_mutating_tool(c: Column) -> Column:
    name = F.lower(F.coalesce(c, F.lit("")))
    return name.isin(*MUTATING_NAMES) | name.rlike("|".join(MUTATION_KEYWORDS))


def mutates_by_shell(c: Column) -> Column:
    return F.lower(F.left(F.coalesce(c, F.lit("")), F.lit(2000))).rlike("|".join(SHELL_WRITES))


def tool_mutates(name: Column, described: Column) -> Column:
    """By its name, or, for a shell, by what it is told."""
    return is_mutating_tool(name) | (F.lower(F.coalesce(name, F.lit(""))).isin(*SHELL_TOOLS) & mutates_by_shell(described))


def looks_failed(c: Column) -> Column:
    head = F.left(F.coalesce(c, F.lit("")), F.lit(1500))
    low = F.lower(head)
    out = F.lit(False)
    for pattern, needs in zip(FAILURES, FAILURE_NEEDS, strict=True):
        there = F.lit(False)
        for need in needs:
            there = there | low.contains(need)
        out = out | F.when(there, head.rlike(pattern)).otherwise(False)
    return out


def base_name(c: Column) -> Column:
    """The last part of a path, in lower case."""
    return F.substring_index(F.translate(F.lower(F.coalesce(c, F.lit(""))), "\\", "/"), "/", -1)


def is_credential_name(base: Column) -> Column:
    """A last part that ends with a dotted hint or contains another."""
    out = F.lit(False)
    for hint in CREDENTIAL_HINTS:
        out = out | (base.endswith(hint) if hint.startswith(".") else base.contains(hint))
    return out


def is_credential_path(c: Column) -> Column:
    """A path whose last part ends with a dotted hint or contains another."""
    return is_credential_name(base_name(c))


def session_match(cwd: Column, root: Column, hinted: Column) -> Column:
    """confirmed or foreign by the working directory (either may hold the other); else hinted or unknown."""
    within = path_is_within(cwd, root) | path_is_within(root, cwd)
    return F.when(normalize_path(cwd) != "", F.when(within, "confirmed").otherwise("foreign")).when(hinted, "hinted").otherwise("unknown")


def vcs_kind(code: Column) -> Column:
    """The kind of a two-character status code, the first that fits."""
    return (
        F.when(code == "??", "untracked")
        .when(code.contains("U") | code.isin("AA", "DD"), "conflicted")
        .when(code.contains("R"), "renamed")
        .when(code.contains("D"), "deleted")
        .when(code.contains("A"), "added")
        .otherwise("modified")
    )
