import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import block_log, patch_log, rollout_log
from sessionloom.sources.jsonl import parsed, read_jsonl


def lines(spark, records, key="s"):
    rows = [(key, 0, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return parsed(spark.createDataFrame(rows, "session_key string, block_start long, line_no long, line string"))


def events(df):
    return [r.asDict() for r in df.orderBy("block_start", "line_no", "sub_no").collect()]


def test_bad_lines_are_kept_and_blank_ones_dropped(spark, tmp_path):
    body = '{"a":1}\n{not json\n\n[1]\n  {"a":{"b":2}}  \n{"a":\n{"a":1} trailing\n'
    (tmp_path / "x.jsonl").write_bytes(body.encode() + b'{"a":"\xff"}\n')
    got = read_jsonl(spark, str(tmp_path)).orderBy("block_start", "line_no").select("ok", F.to_json("v").alias("j")).collect()
    assert [r["ok"] for r in got] == [True, False, False, True, False, False, True]
    assert got[-1]["j"] == '{"a":"\ufffd"}'


def test_line_order_over_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join('{"n":%d,"pad":"%s"}\n' % (i, "p" * 50) for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = read_jsonl(spark, str(tmp_path)).orderBy("block_start", "line_no").select(F.try_variant_get("v", "$.n", "int")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[0] for r in rows] == list(range(2000))


def block(role, content, **more):
    return {"type": role, "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": role, "content": content}, **more}


def test_block_log(spark):
    records = [
        {"type": "mode", "x": 1},
        block("user", "<reminder>plain text is not filtered</reminder>"),
        block("user", [{"type": "text", "text": "<reminder>filtered</reminder>"}, {"type": "text", "text": "do it"}]),
        block("assistant", [{"type": "thinking", "thinking": "x"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": " /a ", "old_string": "x", "edits": [{"path": "/b"}, {"n": 1}]}}, {"type": "tool_use", "name": "Go", "input": {"n": [1]}}, {"type": "tool_use", "name": "Bare"}]),
        block("user", [{"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "bad"}, {"type": "image"}, "s"]}, {"type": "tool_result", "content": {"k": 1}}, {"type": "tool_result"}]),
        block("user", [{"type": "text", "text": "sum"}], isCompactSummary=True),
        {"type": "summary", "summary": "S"},
        {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto"}},
        {"type": "system", "subtype": "other"},
        block("user", "  "),
        "{broken",
    ]
    got = events(block_log.normalize(lines(spark, records)))
    assert [(e["kind"], e["text"]) for e in got] == [
        ("user_message", "<reminder>plain text is not filtered</reminder>"),
        ("user_message", "do it"),
        ("tool_call", "file_path: /a\nold_string: x"),
        ("tool_call", '{"n":[1]}'),
        ("tool_call", "Bare"),
        ("tool_error", "bad\n[image omitted]\ns"),
        ("tool_result", '{"k":1}'),
        ("tool_result", ""),
        ("compaction", "sum"),
        ("compaction", "S"),
        ("compaction", '{"trigger":"auto"}'),
    ]
    assert got[2]["file_paths"] == ["/a", "/b"] and got[2]["mutating"] and not got[3]["mutating"]
    assert got[5]["is_error"] and got[0]["ts_raw"] == "2026-01-01T00:00:00+00:00" and got[0]["session_id"] == "s1"


def item(t, **more):
    return {"type": t, "timestamp": 1757412000, "payload": more}


def test_rollout_log(spark):
    say = lambda role, text: item("response_item", type="message", role=role, content=[{"type": "input_text", "text": text}])
    done = lambda **i: item("event_msg", type="item_completed", item=i)
    records = [
        say("user", "early"),
        item("session_meta", session_id="abc", cwd="/r", cli_version="1"),
        say("developer", "boilerplate"),
        say("user", "fix it "),
        done(type="UserMessage", content=[{"type": "text", "text": "fix it"}]),
        done(type="UserMessage", content="other"),
        say("assistant", "fix it"),
        say("user", "<context_block>x</context_block>"),
        item("response_item", type="function_call", name="exec", arguments="apply_patch x"),
        item("response_item", type="local_shell_call"),
        item("response_item", type="function_call_output", output='{"exit_code": 1}'),
        item("response_item", type="function_call_output", output={"content": [{"type": "text", "text": "fine"}]}),
        item("response_item", type="reasoning", encrypted_content="x"),
        done(type="FileChange", changes={"z.py": {"type": "update"}, "a.py": {"type": "add"}}),
        done(type="McpToolCall", server="srv", tool="write_it", title="T"),
        done(type="Error", message="broke"),
        done(type="ContextCompaction"),
        item("compacted", replacement_history=[1, 2]),
        item("turn_context", cwd="/r"),
    ]
    got = events(rollout_log.normalize(lines(spark, records)))
    assert [(e["kind"], e["tool_name"], e["text"]) for e in got] == [
        ("user_message", None, "early"),
        ("session_metadata", None, "session_id: abc\ncwd: /r\ncli_version: 1"),
        ("user_message", None, "fix it "),
        ("user_message", None, "other"),
        ("assistant_message", None, "fix it"),
        ("tool_call", "exec", "apply_patch x"),
        ("tool_call", "local_shell_call", "null"),
        ("tool_error", None, '{"exit_code": 1}'),
        ("tool_result", None, "fine"),
        ("tool_call", "FileChange", "update: z.py\nadd: a.py"),
        ("tool_call", "srv/write_it", "T"),
        ("tool_error", None, "broke"),
        ("compaction", None, "context compaction performed by the agent"),
        ("compaction", None, "context compaction: history replaced with 2 retained item(s)"),
    ]
    assert [e["session_id"] for e in got[:2]] == ["", "abc"]
    assert got[5]["mutating"] and not got[6]["mutating"] and got[9]["mutating"] and not got[10]["mutating"]
    assert got[9]["file_paths"] == ["z.py", "a.py"]
    assert len(events(rollout_log.normalize(lines(spark, records), dedupe=False))) == len(got) + 1


def test_probes(spark):
    got = block_log.probe(lines(spark, [{"type": "x"}, {"attachment": {"snapshot": {"workingDirectory": "/w"}}}, {"sessionId": "a", "cwd": "/late"}])).first()
    assert (got["session_id"], got["cwd"]) == ("a", "/w")
    got = rollout_log.probe(lines(spark, [item("session_meta", id="not hex"), item("turn_context", workspace_roots=["/r"])])).first()
    assert (got["session_id"], got["cwd"]) == (None, "/r")
    far = [{"type": "x"}] * 250 + [{"sessionId": "late"}]
    assert block_log.probe(lines(spark, far)).first()["session_id"] is None


HEAD = {"sessionId": "s9", "projectHash": "h"}


def m(i, text="t", kind="user"):
    return {"id": i, "type": kind, "content": text}


REPLAYS = {
    "replace": ([m("a"), m("b", "old"), {"$set": {"messages": [m("b", "new")]}}], ["new"]),
    "rewind": ([m("a", "A"), m("b", "B"), m("c", "C"), {"$rewindTo": "b"}], ["A"]),
    "rewind to nothing known": ([m("a"), {"$rewindTo": "zz"}], []),
    "sent again in its place": ([m("a", "A"), m("b", "B"), m("a", "A2")], ["A2", "B"]),
    "a header's messages are added": ([m("a", "A"), {**HEAD, "messages": [m("b", "B"), m("a", "A3")]}], ["A3", "B"]),
    "an id twice in one list": ([{"$set": {"messages": [m("a", "1"), m("b", "2"), m("a", "3")]}}], ["3", "2"]),
    "other records": ([m("a", "A"), {"foo": 1}, {"$set": {"x": 1}}, {"id": 5}], ["A"]),
}


@pytest.mark.parametrize("name", REPLAYS)
def test_replay(spark, name):
    records, expected = REPLAYS[name]
    got = events(patch_log.normalize(lines(spark, records)))
    assert [e["text"] for e in got] == expected


def model_replay(records):
    """The state of a message list, written from the rules alone."""
    live = []

    def put(message):
        at = [i for i, x in enumerate(live) if x["id"] == message["id"]]
        if at:
            live[at[0]] = message
        else:
            live.append(message)

    for r in records:
        if "$rewindTo" in r:
            ids = [x["id"] for x in live]
            del live[ids.index(r["$rewindTo"]) if r["$rewindTo"] in ids else 0 :]
        elif "$set" in r:
            live.clear()
            for x in r["$set"]["messages"]:
                put(x)
        elif "projectHash" in r:
            for x in r["messages"]:
                put(x)
        else:
            put(r)
    return [(x["id"], x["content"]) for x in live]


def test_replay_against_a_model(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for s in range(60):
        records = []
        for n in range(rng.randrange(12)):
            some = [m(rng.choice("abcd"), str(n)) for _ in range(rng.randrange(3))]
            records.append(rng.choice([m(rng.choice("abcd"), str(n)), m(rng.choice("abcd"), str(n)), {"$rewindTo": rng.choice("abcx")}, {"$set": {"messages": some}}, {**HEAD, "messages": some}]))
        expected[str(s)] = model_replay(records)
        rows += [(str(s), 0, i, json.dumps(r)) for i, r in enumerate(records)]
    df = parsed(spark.createDataFrame(rows, "session_key string, block_start long, line_no long, line string"))
    got = {k: [] for k in expected}
    for r in patch_log.replay(patch_log.operations(df)).orderBy("session_key", "pos").collect():
        got[r["session_key"]].append((r["id"], json.loads(r["body"])["content"]))
    assert got == expected


def test_replay_broadcasts_no_messages(spark):
    """40,000 messages that Spark takes for 11 KiB, as a file of a hundred MB may hold ten million."""
    listed = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("id")))
    update = F.to_json(F.struct(F.struct(listed.alias("messages")).alias("$set")))
    rows = spark.range(200).select((F.col("id") % 20).cast("string").alias("session_key"), F.lit(0).cast("long").alias("block_start"), F.col("id").alias("line_no"), update.alias("line"))
    live = patch_log.replay(patch_log.operations(parsed(rows)))
    got = live.collect()
    assert sorted((r["session_key"], r["pos"], r["id"], r["line_no"]) for r in got) == sorted((str(s), k, f"m{k}", 180 + s) for s in range(20) for k in range(200))
    assert "Broadcast" not in live._jdf.queryExecution().executedPlan().toString()


def test_patch_messages(spark):
    call = {"name": "write_file", "args": {"file_path": "/f", "content": "x"}, "result": "done"}
    records = [
        HEAD,
        m("1", "/help"),
        m("2", [{"text": "hello"}, {"text": "hidden", "thought": True}]),
        m("3", "<state_snapshot>s</state_snapshot>"),
        m("4", "Got it. Thanks for the additional context!", "gemini"),
        {"id": "5", "type": "gemini", "content": [{"text": "ok"}, {"functionCall": {"name": "run_shell_command", "args": {"command": "echo >> f"}}}], "toolCalls": [call, {"name": "read", "args": {}}]},
        m("6", [{"functionResponse": {"name": "read", "response": {"output": "command failed"}}}]),
        m("7", "oops", "error"),
        m("8", "note", "info"),
        "{bad",
    ]
    got = events(patch_log.normalize(lines(spark, records)))
    assert [(e["kind"], e["tool_name"], e["text"], e["mutating"]) for e in got] == [
        ("user_message", None, "hello", False),
        ("compaction", None, "<state_snapshot>s</state_snapshot>", False),
        ("assistant_message", None, "ok", False),
        ("tool_call", "run_shell_command", "command: echo >> f", True),
        ("tool_call", "write_file", "file_path: /f", True),
        ("tool_result", "write_file", "done", False),
        ("tool_call", "read", "", False),
        ("tool_error", "read", "command failed", False),
        ("tool_error", None, "oops", False),
    ]
    assert {e["session_id"] for e in got} == {"s9"} and got[4]["file_paths"] == ["/f"]


@pytest.mark.parametrize(
    ("records", "expected"),
    [
        ([m("a"), {"$set": {"memoryScratchpad": "n"}}], ("n", False)),
        ([{"$set": {"memoryScratchpad": "n"}}, m("a")], ("n", True)),
        ([{"$set": {"memoryScratchpad": "n"}}, {"$rewindTo": "a"}], ("n", True)),
        ([{"$set": {"memoryScratchpad": "n"}}, {"$set": {"memoryScratchpad": ""}}], None),
        ([{"$set": {"memoryScratchpad": {"k": 1}}}, {"$set": {"x": 1}}], ('{"k":1}', False)),
        ([m("a")], None),
    ],
)
def test_scratchpad(spark, records, expected):
    got = patch_log.scratchpad(lines(spark, records)).collect()
    assert [(r["note"], r["stale"]) for r in got] == ([expected] if expected else [])
