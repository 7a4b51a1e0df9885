"""Reports of one session, rendered on the driver from evidence that limits bound."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.redact import scrub_text
from sessionloom.functions.text import head_tail, human_size
from sessionloom.sources.vcs import Head

NOTHING = "_No events of this kind._\n"
UNDETERMINED = "Unknown: only a model's summary could say; the evidence file holds the sources."
SECTIONS = (
    ("How the session began", ["first_events"]),
    ("Context that was compacted", ["compactions"]),
    ("What the user asked", ["first_user_messages", "last_user_messages"]),
    ("What failed", ["errors"]),
    ("What was changed", ["mutating_tools"]),
    ("How the session ended", ["last_events"]),
)
#: Errors, kinds of events and lines of status that a report lists.
REPORT_ERRORS, REPORT_KINDS, REPORT_STATUS = 3, 6, 40
ALWAYS = {"first_events", "last_events"}


def header(e: Row) -> str:
    """An event's heading: its kind, tool and time."""
    label = e["kind"].replace("_", " ")
    if e["tool_name"]:
        label += f" ({e['tool_name']})"
    return f"{label} - {e['ts_raw']}" if e["ts_raw"] else label


def render_events(events: list[Row]) -> str:
    chunks = [f"### {header(e)}\n\n{e['text'].strip()}\n" for e in events if (e["text"] or "").strip()]
    return "\n".join(chunks) or NOTHING


def collect_buckets(selected: DataFrame, session_key: str) -> dict[str, list[Row]]:
    """One session's evidence; its size is bounded by the limits."""
    out: dict[str, list[Row]] = {}
    for row in selected.where(F.col("session_key") == session_key).orderBy("bucket", "rank").collect():
        out.setdefault(row["bucket"], []).append(row)
    return out


def render_evidence(session: dict, stats: Row, buckets: dict[str, list[Row]], generated_at: str) -> str:
    """The evidence file; sections without events are left out, but for the first and the last."""
    lines = ["# Evidence of a session\n", f"> Generated at {generated_at}", f"> Source: {session['agent']}", f"> Session: {session['session_id'] or 'unknown'}", f"> Transcript: {session['path']}", f"> Events parsed: {stats['total_events']}"]
    if stats["invalid_lines"]:
        lines.append(f"> Invalid lines ignored: {stats['invalid_lines']}")
    if stats["redactions"]:
        lines.append(f"> Possible secrets redacted: {stats['redactions']}")
    out = "\n".join(lines) + "\n\nQuoted from the transcript and cut where marked; the repository decides.\n"
    for title, names in SECTIONS:
        if any(buckets.get(n) for n in names) or ALWAYS & set(names):
            out += f"\n---\n\n## {title}\n\n"
            for name in names:
                if len(names) > 1:
                    out += f"### {'First ones' if name.startswith('first') else 'Last ones'}\n\n"
                out += render_events(buckets.get(name, [])) + "\n"
    return re.sub(r"\n{3,}", "\n\n", out)


def session_meta(session: dict, stats: Row, selected: int, vcs: dict, generated_at: str, digest: str | None) -> str:
    """A session's facts as JSON."""
    found = {
        "generated_at": generated_at,
        "agent": session["agent"],
        "session_id": session["session_id"],
        "source_path": session["path"],
        "source_size": session["size"],
        "source_mtime": str(session["mtime"]),
        "source_sha256": digest,
        "session_cwd": session["cwd"] or stats["session_cwd"],
        "session_match": session["match"],
        "repository": vcs.get("root"),
        "branch": vcs.get("branch"),
        "head": vcs.get("head"),
        "events_parsed": stats["total_events"],
        "events_selected": selected,
        "invalid_lines": stats["invalid_lines"],
        "redactions": stats["redactions"],
        "event_kinds": {k["kind"]: k["n"] for k in stats["event_kinds"] or []},
        "top_tools": {k["tool"]: k["n"] for k in stats["top_tools"] or []},
    }
    return json.dumps(found, indent=2, ensure_ascii=False) + "\n"


def branch_name(head: Head) -> str:
    """The branch; of a detached head, what names the commit."""
    return f"(detached at {head.texts.get('describe') or head.texts.get('head', '')})" if head.detached else head.texts.get("branch", "")


def render_vcs(head: Head, generated_at: str) -> str:
    titles = {"status": "STATUS", "diff_stat": "DIFF STAT (unstaged)", "changed": "CHANGED FILES", "staged_stat": "STAGED STAT", "staged": "STAGED FILES", "commits": "RECENT COMMITS"}
    out = f"Generated: {generated_at}\nRepository: {head.root}\nBranch: {branch_name(head)}\nHEAD: {head.texts.get('head', '')}\n\n"
    return out + "".join(f"=== {title} ===\n\n{head.texts.get(name, '').rstrip() or '(none)'}\n\n" for name, title in titles.items())


def render_tree(head: Head) -> str:
    """A report's section on the working tree; of a long status the first `REPORT_STATUS` lines."""
    status = head.texts.get("status", "").rstrip().splitlines()
    out = f"\n## Git\n\n- Repository: `{head.root}`\n- Branch: `{branch_name(head)}`\n- HEAD: `{head.texts.get('head', '')}`\n- Working tree: {'dirty' if head.dirty else 'clean'}\n"
    if status:
        more = [f"... ({len(status) - REPORT_STATUS} more lines in git-state.txt)"] if len(status) > REPORT_STATUS else []
        out += "\n```\n" + "\n".join(status[:REPORT_STATUS] + more) + "\n```\n"
    if head.texts.get("diff_stat", "").strip():
        out += f"\nNot staged:\n\n```\n{head.texts['diff_stat'].rstrip()}\n```\n"
    return out


def render_memory(entries: list[Row]) -> str:
    lines = [f"- **{e['agent']}**: {e['label']}: `{e['path']}` ({e['detail']})" for e in entries]
    return "\n## Agent memory\n\nListed, never read.\n\n" + ("\n".join(lines) or "None found.") + "\n"


def render_report(session: dict, stats: Row, buckets: dict[str, list[Row]], relevant: list[str], memory: str, generated_at: str, head: Head | None = None) -> str:
    """The report that needs no model: what the evidence itself says, section by section."""
    first = next((e["text"].strip() for e in buckets.get("first_user_messages", []) if e["text"].strip()), UNDETERMINED)
    last = next((e["text"].strip() for e in reversed(buckets.get("last_user_messages", [])) if e["text"].strip()), UNDETERMINED)
    errors = [e["text"].strip().split("\n")[0][:200] for e in buckets.get("errors", [])[-REPORT_ERRORS:]]
    kinds = ", ".join(f"{k['kind']} {k['n']}" for k in (stats["event_kinds"] or [])[:REPORT_KINDS])
    body = {
        "Goal": first,
        "Latest request": last,
        "State": f"{stats['total_events']} events ({kinds})",
        "Decisions": UNDETERMINED,
        "Done": UNDETERMINED,
        "Open": UNDETERMINED,
        "Errors": "\n".join(f"- {e}" for e in errors) or "No errors.",
        "Relevant files": "\n".join(relevant) or "None.",
        "Risks": UNDETERMINED,
        "Next step": UNDETERMINED,
    }
    out = f"# Session report\n\n> Generated at {generated_at}\n> Session: {session['session_id']}\n"
    return out + "".join(f"\n## {title}\n\n{text}\n" for title, text in body.items()) + (render_tree(head) if head else "") + memory


def prompt_column(evidence: F.Column, budget: int) -> F.Column:
    """The text that a model would be given, within its budget; it is redacted once, as the evidence was."""
    return head_tail(evidence, budget)


def render_prompt(spark: SparkSession, session: dict, stats: Row, selected: int, head: Head, state: str, evidence: str, budget: int) -> str:
    """What a model would be given: the facts, the working tree's state, then the evidence, within a budget.

    The state is redacted here, the evidence was when it was selected.
    """
    facts = [
        f"- Repository: {head.root}",
        f"- Branch: {branch_name(head)}",
        f"- HEAD: {head.texts.get('head', '')}",
        f"- Source agent: {session['agent']}",
        f"- Session: {session['session_id'] or 'unknown'}",
        None,
        f"- Events parsed: {stats['total_events']}, selected as evidence: {selected}",
        f"- Working tree: {'dirty' if head.dirty else 'clean'}",
    ]
    row = spark.createDataFrame([(session["size"], state.strip(), evidence)], "size long, state string, evidence string")
    shown = F.concat_ws("\n", *(F.concat(F.lit("- Transcript size: "), F.coalesce(human_size(F.col("size")), F.lit("unknown"))) if f is None else F.lit(f) for f in facts))
    text = F.concat(
        F.lit("# Evidence of a session\n\n## Facts\n\n"), shown,
        F.lit("\n\n## State of the working tree (this is what holds)\n\n```\n"), scrub_text(F.col("state")),
        F.lit("\n```\n\n## What the session said (no proof that it was done)\n\n"), F.col("evidence"),
    )
    return row.select(prompt_column(text, budget).alias("text")).first()["text"]
