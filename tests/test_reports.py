"""Evidence files of many sessions, and results that are withheld with their calls."""

import os

from pyspark.sql import functions as F

from sessionloom.config import Limits
from sessionloom.operators import block_log, evidence, patch_log, rollout_log
from sessionloom.plans import render, reports, snapshot
from tests.test_dialects import block, events, item, lines


def many(spark, n):
    """`n` sessions of the block dialect, some without events, some with bad lines and secrets."""
    record = F.when(F.col("k") == 0, F.concat(F.lit('{"type":"user","sessionId":"s'), F.col("s").cast("string"), F.lit('","timestamp":"2026-01-01T00:00:00Z","message":{"role":"user","content":"ask \\\\n\\\\n\\\\n\\\\n token=abcdefgh"}}')))
    record = record.when(F.col("k") == 1, F.lit('{"type":"assistant","message":{"role":"assistant","content":[{"type":"tool_use","name":"Edit","input":{"file_path":"/a"}},{"type":"text","text":"done"}]}}'))
    record = record.when((F.col("k") == 2) & (F.col("s") % 3 == 0), F.lit("{bad")).when(F.col("k") == 3, F.lit('{"type":"summary","summary":"S"}')).otherwise('{"type":"user","message":{"role":"user","content":[{"type":"tool_result","is_error":true,"content":"it failed"}]}}')
    rows = spark.range(n).withColumnRenamed("id", "s").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.where("s % 10 <> 9 OR k = 2").select(F.concat(F.lit("file:///l/"), F.col("s").cast("string"), F.lit(".jsonl")).alias("session_key"), F.lit(0).cast("long").alias("block_start"), F.col("k").cast("long").alias("line_no"), record.alias("line"))


def test_evidence_of_all_sessions(spark, tmp_path):
    from sessionloom.sources.jsonl import parsed

    n = 3000
    found = parsed(many(spark, n))
    selected, stats = snapshot.build_evidence(block_log.normalize(found), found, Limits(max_compactions=1))
    sessions = spark.range(n).select(F.lit("block").alias("agent"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("session_id"), F.concat(F.lit("file:///l/"), F.col("id").cast("string"), F.lit(".jsonl")).alias("path"))
    texts = reports.evidence_texts(sessions, selected, stats, "now")
    written = reports.write_texts(texts, f"file://{tmp_path}/out dir").cache()
    assert written.count() == n == len(os.listdir(tmp_path / "out dir")) and written.select("path").distinct().count() == n
    places = {r["session_key"]: r["path"] for r in written.collect()}
    for k in (0, 1, 7, 9, 19, 2997):
        key = f"file:///l/{k}.jsonl"
        session = {"agent": "block", "session_id": f"s{k}" if k % 7 else None, "path": key}
        want = render.render_evidence(session, stats.where(F.col("session_key") == key).first(), render.collect_buckets(selected, key), "now")
        assert open(places[key]).read() == want
    again = reports.write_texts(texts.where("session_key = 'file:///l/5.jsonl'"), f"{tmp_path}/out dir".replace(str(tmp_path), f"file://{tmp_path}")).first()
    assert again["path"] == places["file:///l/5.jsonl"] and len(os.listdir(tmp_path / "out dir")) == n


def test_results_of_withheld_calls(spark):
    use = lambda i, **given: {"type": "tool_use", "id": i, "name": "Read", "input": given}
    answer = lambda i, text: {"type": "tool_result", "tool_use_id": i, "content": text}
    blocks = [block("assistant", [use("t1", file_path="/h/.env"), use("t2", file_path="/h/a.py"), use("t3", command="cat ~/.ssh/id_rsa")]), block("user", [answer("t1", "inside"), answer("t2", "code"), answer("t3", "a key"), answer("", "none")])]
    call = lambda i, text: item("response_item", type="function_call", name="exec", call_id=i, arguments=text)
    output = lambda i, text: item("response_item", type="function_call_output", call_id=i, output=text)
    rollouts = [call("c1", "/h/.env"), output("c1", "inside"), output("c2", "other")]
    tools = [{"name": "read_file", "args": {"path": "/h/.env"}, "result": "inside"}, {"name": "read_file", "args": {"path": "/h/a"}, "result": "code"}]
    patches = [{"id": "m", "type": "gemini", "content": "", "toolCalls": tools}]
    results = {}
    for name, dialect, records in (("block", block_log, blocks), ("rollout", rollout_log, rollouts), ("patch", patch_log, patches)):
        found = dialect.normalize(lines(spark, records))
        for strict in (False, True):
            results[name, strict] = [e["text"] for e in events(evidence.trim(found, strict=strict)) if e["kind"] in ("tool_result", "tool_error")]
    hidden = evidence.WITHHELD_RESULT
    assert results["block", False] == ["inside", "code", "a key", "none"] and results["rollout", False] == ["inside", "other"] and results["patch", False] == ["inside", "code"]
    assert results["patch", True] == [hidden, "code"] and results["rollout", True] == [hidden, "other"]
    assert results["block", True][:2] == [hidden, "code"] and results["block", True][3] == "none"
