"""What is read of the files: heads, one session alone, changed files; and what is moved."""

import io
import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import archive, discovery, patch_log, rollout_log
from sessionloom.plans import snapshot as plans
from sessionloom.sources import heads, jsonl, vcs
from sessionloom.sources.files import exact_path, plain_path
from tests.test_dialects import block, events, item, lines
from tests.test_plans import logs, repo  # noqa: F401


class Counted(io.BytesIO):
    read_bytes = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.read_bytes += n
        return n


def test_only_the_head_is_read():
    body = b"".join(b'{"n":%d}\r\n' % i for i in range(300_000))
    stream = Counted(body)
    got = list(heads.head_lines(stream, 200, 512 << 10))
    assert got == ['{"n":%d}' % i for i in range(200)] and stream.read_bytes <= 2 * heads.CHUNK
    long = Counted(b"a\n" + b"x" * (4 << 20))
    assert list(heads.head_lines(long, 200, 512 << 10)) == ["a"] and long.read_bytes <= (512 << 10) + 2 * heads.CHUNK
    assert list(heads.head_lines(Counted(b""), 5, 100)) == []
    assert list(heads.head_lines(Counted(b"\xff\n\xe6\x97\xa5\rb"), 5, 100)) == ["�", "日", "b"]
    assert list(heads.head_lines(Counted(b"12345\n123\n"), 5, 10)) == ["12345"]  # the line that reaches the limit is left out


def test_huge_files_are_probed_by_their_heads(spark, tmp_path):
    """Two sparse files of 1 TiB: reading them whole would not end."""
    folder = tmp_path / "logs" / "a b[1]"
    folder.mkdir(parents=True)
    for k in range(2):
        path = folder / f"{k} %x.jsonl"
        path.write_text(json.dumps({"type": "user", "sessionId": f"s{k}", "cwd": "/w/r"}) + "\n")
        os.truncate(path, 1 << 40)
    began = time.time()
    found = plans.discover_sessions(spark, "block", str(tmp_path / "logs"), "/w/r").orderBy("path").collect()
    assert [(r["session_id"], r["cwd"], r["match"], r["size"]) for r in found] == [(f"s{k}", "/w/r", "confirmed", 1 << 40) for k in range(2)] and time.time() - began < 60


def test_probing_agrees_with_reading(spark, tmp_path):
    rng = random.Random(4)
    for agent, root, name in (("block", "p", "{}.jsonl"), ("rollout", "2026/01", "rollout-{}.jsonl"), ("patch", "p/chats", "session-{}.jsonl")):
        folder = tmp_path / agent / root
        folder.mkdir(parents=True)
        for k in range(12):
            records = [{"x": "y" * rng.choice([1, 3000])} for _ in range(rng.choice([0, 3, 59, 60, 61, 199, 200, 201]))]
            records += [{"sessionId": f"{k:08x}", "cwd": "/w", "projectHash": "h", "payload": {"session_id": f"{k:08x}", "cwd": "/w"}}, "{bad"]
            (folder / name.format(k)).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
        root = str(tmp_path / agent)
        files = plans.session_files(spark, agent, root)
        whole = plans.DIALECTS[agent].probe(plans.read_transcripts(spark, agent, root)).select("session_key", "session_id", "cwd")
        probed = plans.probe_files(spark, agent, root, files).select("session_key", "session_id", "cwd")
        assert sorted(map(str, whole.collect())) == sorted(map(str, probed.collect()))


def test_one_session_is_read_alone(spark, tmp_path, repo, logs):  # noqa: F811
    other = os.path.join(logs, "p", "odd {name}*[x] %41.jsonl")
    with open(other, "w") as f:
        f.write(json.dumps(block("user", "hello", cwd=repo)) + "\n")
    found = {plain_path(r["path"]): r["path"] for r in plans.discover_sessions(spark, "block", logs, repo).collect()}
    assert set(found) == {other, os.path.join(logs, "p", "one.jsonl")}
    got = plans.read_session(spark, found[other])
    assert got.count() == 1 and len(got.inputFiles()) == 1 and exact_path("/a*") == "/a\\*"
    one = plans.read_session(spark, found[os.path.join(logs, "p", "one.jsonl")])
    assert [plain_path(f) for f in one.inputFiles()] == [os.path.join(logs, "p", "one.jsonl")]
    assert "InMemoryFileIndex(1 paths)" in one._jdf.queryExecution().executedPlan().toString()


def test_explicit_session_and_rebuilding(spark, tmp_path, repo, logs):  # noqa: F811
    out, elsewhere = str(tmp_path / "out"), str(tmp_path / "elsewhere.jsonl")
    with open(elsewhere, "w") as f:
        f.write(json.dumps(block("user", "from another place with password=abcdefgh", cwd="/nowhere")) + "\n")
    paths = plans.snapshot(spark, "block", logs, repo, out, session_file=elsewhere)
    facts = json.load(open(paths["session.json"]))
    assert (facts["session_match"], facts["session_cwd"], facts["events_parsed"]) == ("explicit", "/nowhere", 1)
    with pytest.raises(discovery.NoSession):
        plans.snapshot(spark, "block", logs, repo, out, session_file="/no/such.jsonl")
    prompt = open(paths["prompt.md"]).read()
    order = ["# Evidence of a session", "- Branch: main", "- Transcript size: ", "- Events parsed: 1, selected as evidence: 1", "- Working tree: dirty", "=== STATUS ===", "from another place"]
    assert [prompt.index(x) for x in order] == sorted(prompt.index(x) for x in order) and "abcdefgh" not in prompt
    # the transcript is gone, the tree has changed
    os.unlink(elsewhere)
    for k in range(50):
        open(os.path.join(repo, f"new{k:02}.txt"), "w").close()
    again = plans.rebuild(spark, repo, out)
    report = open(again["report.md"]).read()
    assert "from another place" in report and "?? new00.txt" in report and "new49.txt" in open(again["git-state.txt"]).read()
    status = report.split("```\n")[1].splitlines()
    assert len(status) == 41 and re.match(r"\.\.\. \(\d+ more lines in git-state.txt\)", status[40])
    assert len(os.listdir(os.path.join(out, "history"))) == 1 and json.load(open(again["session.json"]))["source_sha256"] == facts["source_sha256"]
    with pytest.raises(discovery.NoSession):
        plans.rebuild(spark, repo, str(tmp_path / "none"))


def test_a_detached_head_has_a_name(repo):  # noqa: F811
    from sessionloom.plans.render import branch_name, render_tree

    vcs.git(repo, "checkout", "-q", "--detach")
    head = vcs.collect(repo)
    assert head.detached and branch_name(head) == "(detached at heads/main)" and "- Branch: `(detached at heads/main)`" in render_tree(head)


def test_catalogue_opens_changed_files_alone(spark, tmp_path, monkeypatch):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    paths = [folder / f"{k}.jsonl" for k in range(4)]
    write = lambda path, name: path.write_text(json.dumps({"type": "user", "sessionId": name, "cwd": "/w"}) + "\n")
    for k, path in enumerate(paths):
        write(path, f"s{k}")
        os.utime(path, (1_700_000_000, 1_700_000_000))
    opened = []
    probe = plans.probe_files
    monkeypatch.setattr(plans, "probe_files", lambda spark, agent, root, files: opened.append(files.count()) or probe(spark, agent, root, files))
    look = lambda: {r["session_id"] for r in plans.discover_sessions(spark, "block", str(tmp_path / "logs"), "/w", catalogue=str(tmp_path / "cat")).collect()}
    assert look() == {"s0", "s1", "s2", "s3"} and look() == {"s0", "s1", "s2", "s3"} and opened == [4, 0]
    write(paths[0], "t0")  # of the same size and time: not opened
    os.utime(paths[0], (1_700_000_000, 1_700_000_000))
    write(paths[1], "t1")
    paths[2].unlink()
    write(folder / "9.jsonl", "s9")
    assert look() == {"s0", "t1", "s3", "s9"} and opened[2:] == [2]
    # a version that was not finished does not count, and old ones go
    os.makedirs(tmp_path / "cat" / "block" / "version=9")
    assert look() == {"s0", "t1", "s3", "s9"} and opened[3:] == [0]
    assert sorted(os.listdir(tmp_path / "cat" / "block")) == ["version=3", "version=4", "version=9"]


# --- replay


def model(ops):
    """The messages left, told plainly."""
    live = []
    for op in ops:
        if "$rewindTo" in op:
            ids = [m["id"] for m in live]
            live = live[: ids.index(op["$rewindTo"])] if op["$rewindTo"] in ids else []
            continue
        if "$set" in op:
            if not isinstance(op["$set"].get("messages"), list):
                continue
            live, new = [], op["$set"]["messages"]
        else:
            new = op.get("messages", []) if "projectHash" in op else [op]
        for m in new:
            if not isinstance(m, dict) or "id" not in m:
                continue
            at = next((i for i, x in enumerate(live) if x["id"] == m["id"]), len(live))
            live[at : at + 1] = [m]
    return [(m["id"], m.get("n")) for m in live]


def test_replay_agrees_with_the_model(spark):
    rng = random.Random(8)
    logs_ = {}
    for k in range(40):
        name = lambda: f"m{rng.randrange(12)}"
        message = lambda: {"id": name(), "n": rng.randrange(1000)}
        ops = []
        for _ in range(rng.randrange(60)):
            kind = rng.random()
            if kind < 0.7:
                ops.append(message())
            elif kind < 0.8:
                ops.append({"$rewindTo": name()})
            elif kind < 0.87:
                ops.append({"$set": {"messages": [message() for _ in range(rng.randrange(6))] + ["no message", {"n": 1}]}})
            elif kind < 0.92:
                ops.append({"$set": {"memoryScratchpad": "x"}})
            else:
                ops.append({"sessionId": "S", "projectHash": "h", "messages": [message() for _ in range(rng.randrange(4))]})
        logs_[f"log{k}"] = ops
    rows = None
    for key, ops in logs_.items():
        rows = [*(rows or []), *[(key, 0, i, json.dumps(o)) for i, o in enumerate(ops)]]
    df = jsonl.parsed(spark.createDataFrame(rows, "session_key string, block_start long, line_no long, line string").repartition(7))
    got = patch_log.replay(patch_log.operations(df)).orderBy("session_key", "pos").collect()
    have = {key: [] for key in logs_}
    for r in got:
        assert r["pos"] == len(have[r["session_key"]])
        have[r["session_key"]].append((r["id"], json.loads(r["body"]).get("n")))
    assert have == {key: model(ops) for key, ops in logs_.items()}


def test_replay_is_linear(spark):
    """100,000 messages in one log, each rewritten once, and rewinds in between."""
    n = 100_000
    ids = spark.range(2 * n).select(F.lit("s").alias("session_key"), F.lit(0).cast("long").alias("block_start"), F.col("id").alias("line_no"), F.lit("upsert").alias("op"), F.lit(None).cast("string").alias("id"), F.array(F.struct(F.concat(F.lit("m"), (F.col("id") % n).cast("string")).alias("id"), F.parse_json(F.col("id").cast("string")).alias("m"))).alias("messages"))
    none = F.array().cast("array<struct<id:string,m:variant>>")
    back = spark.range(1, 11).select(F.lit("s").alias("session_key"), F.lit(0).cast("long").alias("block_start"), (F.col("id") + 2 * n).alias("line_no"), F.lit("rewind").alias("op"), F.concat(F.lit("m"), (n - F.col("id") * 100).cast("string")).alias("id"), none.alias("messages"))
    began = time.time()
    ops = ids.unionByName(back).withColumn("ids", F.col("messages.id"))
    row = patch_log.replay(ops).agg(F.count("*").alias("n"), F.max("pos").alias("most"), F.min(F.col("body").cast("long")).alias("least"), F.bool_and(F.col("body").cast("long") == F.col("pos") + n).alias("last")).first()
    assert (row["n"], row["most"], row["least"], row["last"]) == (n - 1000, n - 1001, n, True) and time.time() - began < 30


# --- what is moved


def test_no_text_is_shuffled_to_find_repeats(spark):
    say = lambda text: item("response_item", type="message", role="user", content=[{"type": "input_text", "text": text}])
    records = [say("a"), item("session_meta", session_id="x"), say(" a "), say("b"), item("event_msg", type="item_completed", item={"type": "UserMessage", "content": "b"}), item("response_item", type="message", role="assistant", content="a")]
    out = rollout_log.normalize(lines(spark, records))
    assert [(e["kind"], e["text"], e["session_id"]) for e in events(out)] == [("user_message", "a", ""), ("session_metadata", "session_id: x", "x"), ("user_message", "b", "x"), ("assistant_message", "a", "x")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"\bExchange (hash|range|Single|Round)", plan)


def test_an_archive_reads_the_partitions_it_must(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = spark.range(600).select(F.col("id").cast("string").alias("name"), F.concat(F.lit("report "), F.col("id").cast("string")).alias("content"))
    assert archive.append_new(first, path).count() == 600
    one = spark.createDataFrame([("x", "report 5"), ("y", "report 1000"), ("z", "report 1000"), ("n", None), ("m", None)], "name string, content string")
    assert sorted(r["content"] or "" for r in archive.append_new(one, path).collect()) == ["", "report 1000"]
    assert archive.append_new(one, path).count() == 0 and spark.read.parquet(path).count() == 602
    plan = archive.kept_hashes(spark, path, ["ab"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hash:string>" in plan and "prefix" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    assert archive.append_new(first.limit(0), path).count() == 0
