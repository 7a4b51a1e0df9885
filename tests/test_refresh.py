"""Growing sessions: what was appended is merged, and equals a full run."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.config import Limits
from sessionloom.operators import evidence
from sessionloom.plans import refresh as plan
from sessionloom.sources import ranges
from sessionloom.sources.files import file_listing
from tests.test_dialects import block, item


def test_ranges_hold_every_line_once():
    rng = random.Random(2)
    for case in range(200):
        body = b"".join(bytes(rng.choice(b"ab\xc3\r") for _ in range(rng.randrange(9))) + b"\n" for _ in range(rng.randrange(8))) + b"x" * rng.randrange(3)
        starts = [0] + [i + 1 for i, c in enumerate(body) if c == 10]
        begin, step = rng.choice(starts), rng.randrange(1, 12)
        got = []
        for at in range(begin, len(body), step):
            got += ranges.range_lines(io.BytesIO(body), at, min(at + step, len(body)), len(body), at == begin)
        want, at = [], begin
        for line in body[begin:].split(b"\n")[:-1]:
            want.append((at, at + len(line) + 1, line))
            at += len(line) + 1
        assert got == want, (body, begin, step)


LIMITS = Limits(first_events=3, last_events=4, max_errors=2, max_tool_events=2, max_compactions=2, max_user_messages=4)
SHOWN = ["session_key", "bucket", "rank", "line_no", "sub_no", "kind", "text", "session_id"]


def record(agent, rng):
    if agent == "block":
        return rng.choice([
            block("user", [{"type": "text", "text": f"say {rng.randrange(5)} token=abcdefgh{rng.randrange(9)}"}]),
            block("assistant", [{"type": "tool_use", "name": rng.choice(["Edit", "Grep"]), "input": {"file_path": "/a"}}, {"type": "text", "text": "well"}]),
            block("user", [{"type": "tool_result", "is_error": rng.random() < 0.5, "content": "bad"}]),
            {"type": "summary", "summary": "S"},
            "{bad",
            "",
        ])
    return rng.choice([
        item("response_item", type="message", role="user", content=[{"type": "input_text", "text": f"say {rng.randrange(6)}"}]),
        item("event_msg", type="item_completed", item={"type": "UserMessage", "content": f"say {rng.randrange(6)}"}),
        item("response_item", type="function_call", name="exec", arguments="ls"),
        item("session_meta", session_id=f"id{rng.randrange(9)}", cwd=f"/w/{rng.randrange(9)}"),
        item("compacted", message="m"),
        "nothing",
    ])


def shown(selected, stats):
    return sorted(map(str, selected.select(*SHOWN).collect())), sorted(map(str, stats.select("session_key", "total_events", "redactions", "session_cwd", F.to_json("event_kinds"), F.to_json("top_tools"), "invalid_lines").collect()))


@pytest.mark.parametrize("agent", ["block", "rollout"])
def test_refreshing_equals_a_full_run(spark, tmp_path, monkeypatch, agent):
    monkeypatch.setattr(ranges, "RANGE", 300)
    rng = random.Random(agent)
    logs = tmp_path / "logs"
    logs.mkdir()
    read = []
    real = plan.read_ranges
    monkeypatch.setattr(plan, "read_ranges", lambda todo: read.append(todo.agg(F.sum(F.col("size") - F.col("begin"))).first()[0]) or real(todo))

    def append(name, n):
        with open(logs / name, "a") as f:
            f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in (record(agent, rng) for _ in range(n))))

    for turn in range(3):
        for name in ("a.jsonl", "b.jsonl", f"new{turn}.jsonl"):
            append(name, rng.randrange(5, 15))
        if turn == 1:
            (logs / "new0.jsonl").unlink()
            (logs / "b.jsonl").write_text(json.dumps(record(agent, rng)) + "\n")  # shorter: read anew
            with open(logs / "a.jsonl", "a") as f:
                f.write('{"unfinished')
        if turn == 2:
            with open(logs / "a.jsonl", "a") as f:
                f.write('": 1}\n')
        files = file_listing(spark, str(logs))
        got = shown(*plan.refresh(spark, agent, files, str(tmp_path / "state"), LIMITS))
        whole = shown(*plan.refresh(spark, agent, files, str(tmp_path / f"full{turn}"), LIMITS))
        assert got == whole
    total = sum(os.path.getsize(logs / f) for f in os.listdir(logs))
    assert read[-1] == total and read[-2] < total  # the full run reads all, the refresh what is new
    before = read[-2]
    again = shown(*plan.refresh(spark, agent, file_listing(spark, str(logs)), str(tmp_path / "state"), LIMITS))
    assert again == got and read[-1] == 0 < before
    assert sorted(os.listdir(tmp_path / "state")) == ["version=3", "version=4"]


def test_a_log_that_rewinds_is_no_growing_one(spark, tmp_path):
    with pytest.raises(ValueError, match="don't only grow"):
        plan.refresh(spark, "patch", spark.createDataFrame([], "session_key string, size long"), str(tmp_path))


def test_merged_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), 0, i, 0, rng.choice(["user_message", "tool_call", "compaction", "tool_error"]), f"t{i}", rng.random() < 0.3, rng.random() < 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "session_key string, block_start long, line_no long, sub_no int, kind string, text string, is_error boolean, mutating boolean")
    whole = evidence.select_buckets(df, LIMITS)
    halves = [evidence.select_buckets(df.where(f"line_no % 3 = {k}"), LIMITS) for k in range(3)]
    merged = evidence.merge_buckets(halves[0].unionByName(halves[1]).unionByName(halves[2]), LIMITS)
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
