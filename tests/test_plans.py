import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import discovery
from sessionloom.plans import snapshot as plans
from sessionloom.sources import vcs
from sessionloom.sources.files import archive_path, digests, file_listing, memory_index, sha256_file, write_atomic
from sessionloom.streaming.ingest import event_rates, ingest


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "work_repo"
    path.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (path / "a.py").write_text("1")
    run("add", ".")
    run("commit", "-qm", "first")
    (path / "a.py").write_text("2")
    (path / "b.py").write_text("3")
    return str(path)


@pytest.fixture
def logs(tmp_path, repo):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    say = lambda role, *blocks: {"type": role, "sessionId": "sess-1", "cwd": repo, "timestamp": "2026-01-01T00:00:00Z", "message": {"role": role, "content": list(blocks)}}
    records = [
        say("user", {"type": "text", "text": "please fix a.py with token=abcdefgh"}),
        say("assistant", {"type": "tool_use", "name": "Edit", "input": {"file_path": f"{repo}/a.py"}}),
        say("user", {"type": "tool_result", "is_error": True, "content": "it failed"}),
    ]
    (folder / "one.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + "{bad\n")
    (folder / "sub").mkdir()
    (folder / "sub" / "deeper.jsonl").write_text("{}\n")
    return str(tmp_path / "logs")


def test_snapshot(spark, tmp_path, repo, logs):
    out = str(tmp_path / "out")
    paths = plans.snapshot(spark, "block", logs, repo, out)
    facts = json.load(open(paths["session.json"]))
    assert (facts["session_id"], facts["session_match"], facts["events_parsed"], facts["invalid_lines"], facts["redactions"], facts["branch"]) == ("sess-1", "confirmed", 3, 1, 1, "main")
    assert facts["events_selected"] == 3 and facts["top_tools"] == {"Edit": 1} and len(facts["source_sha256"]) == 64
    report = open(paths["report.md"]).read()
    assert "token=[REDACTED]" in report and "- `a.py` - touched by the session" in report and "- `b.py`" in report and "it failed" in report
    evidence = open(paths["evidence.md"]).read()
    assert "## What failed" in evidence and "abcdefgh" not in evidence
    from datetime import datetime

    when = datetime(2026, 1, 1)
    assert plans.preserve(out, "report.md", "block", "sess-1", when).endswith("20260101-000000-block-sess-1.md")
    assert plans.preserve(out, "report.md", "block", "sess-1", when) is None
    assert plans.show(out) == report and plans.show(out, "nothing.md") is None
    open(paths["report.md"], "a").write("a note of one's own")
    assert plans.recover(spark, "block", logs, repo, out) == paths and "a note" not in plans.show(out) and len(os.listdir(os.path.join(out, "history"))) == 2


def test_status_and_saved_tables(spark, tmp_path, repo, logs):
    roots = {"block": logs}
    assert [r["session_id"] for r in plans.status(spark, roots, repo).collect()] == ["sess-1"]
    row = plans.doctor(spark, {**roots, "rollout": "/nowhere"}, repo).first()
    assert (row["sessions"], row["linked"]) == (1, 1)
    lines = plans.read_transcripts(spark, "block", logs)
    selected, stats = plans.build_evidence(plans.normalize(lines, "block"), lines)
    plans.save(selected, stats, str(tmp_path / "saved"))
    changed = vcs.vcs_changes(spark, vcs.collect(repo))
    got = plans.consolidate(spark, str(tmp_path / "saved"), changed).first()
    assert got["total_events"] == 3 and {c["change_kind"]: c["n"] for c in got["changes"]} == {"modified": 1, "untracked": 1}
    with pytest.raises(ValueError, match="unknown dialect"):
        plans.normalize(lines, "other")
    with pytest.raises(discovery.NoSession):
        plans.snapshot(spark, "block", logs, "/elsewhere", str(tmp_path / "o"))


def test_other_layouts(spark, tmp_path):
    chats = tmp_path / "g" / "my-repo" / "chats"
    (chats / "parent").mkdir(parents=True)
    (chats / "session-1-0a1b2c3d.jsonl").write_text('{"sessionId":"S","projectHash":"h"}\n{"id":"1","type":"user","content":"hi"}\n')
    (chats / "parent" / "x.jsonl").write_text("{}\n")
    (tmp_path / "g" / "my-repo" / ".project_root").write_text("/w/my_repo\n")
    found = plans.discover_sessions(spark, "patch", str(tmp_path / "g"), "/w/my_repo").collect()
    assert [(r["session_id"], r["cwd"], r["match"]) for r in found] == [("S", "/w/my_repo", "confirmed")]
    deep = tmp_path / "r" / "2026" / "01"
    deep.mkdir(parents=True)
    (deep / "other.jsonl").write_text("{}\n")
    assert plans.read_transcripts(spark, "rollout", str(tmp_path / "r")).count() == 1
    (deep / "rollout-x.jsonl").write_text("{}\n{}\n")
    assert plans.read_transcripts(spark, "rollout", str(tmp_path / "r")).count() == 2


def test_files(spark, tmp_path):
    path = str(tmp_path / "a.md")
    write_atomic(path, "one")
    write_atomic(path, "two")
    assert open(path).read() == "two" and os.listdir(tmp_path) == ["a.md"]
    assert archive_path(str(tmp_path), "a.md").endswith("a-1.md")
    assert sha256_file(path) == digests(file_listing(spark, path)).first()["sha256"] and sha256_file("/nowhere") is None
    assert file_listing(spark, str(tmp_path)).first()["size"] == 3
    got = memory_index(spark, [("x", "Notes", str(tmp_path)), ("x", "File", path), ("x", "None", "/nowhere")], {"a.md"}).collect()
    assert got[0]["detail"].startswith("1 file(s), newest ") and got[1]["detail"] == "3 B, untracked" and len(got) == 2
    assert vcs.collect(str(tmp_path / "none")) is None


def test_streaming_ingest(spark, tmp_path, logs):
    table, check = str(tmp_path / "t"), str(tmp_path / "c")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, f"{logs}/p", "block", table, check, lambda b: seen.append(b.count())).awaitTermination()
    assert seen == [3] and spark.read.parquet(table).count() == 3
    rates = event_rates(spark.read.parquet(table)).collect()
    assert sum(r["n"] for r in rates) == 3
