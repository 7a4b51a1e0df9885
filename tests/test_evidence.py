from pyspark.sql import functions as F

from sessionloom.config import Limits, deep_merge, llm_ready, load_config
from sessionloom.operators import archive, discovery, evidence, relevance
from sessionloom.operators import events as ev

SCHEMA = "session_key string, block_start long, line_no long, sub_no int, kind string, text string, tool_name string, file_paths array<string>, is_error boolean, mutating boolean"


def table(spark, rows, session="s"):
    full = [(session, 0, i, 0, r[0], r[1], *(r[2:] + (None, [], False, False)[len(r) - 2 :])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_buckets(spark):
    rows = [(ev.USER, f"u{i}") for i in range(10)] + [(ev.TOOL_CALL, "c", "Edit", [], False, True), (ev.TOOL_ERROR, "e", None, [], True, False), (ev.COMPACTION, "z"), (ev.METADATA, "cwd: /w")]
    limits = Limits(first_events=2, last_events=3, max_errors=4, max_tool_events=0, max_compactions=1, max_user_messages=1)
    got = {}
    for r in evidence.select_buckets(table(spark, rows), limits).orderBy("bucket", "rank").collect():
        got.setdefault(r["bucket"], []).append((r["rank"], r["text"]))
    assert got == {
        "first_events": [(1, "u0"), (2, "u1")],
        "last_events": [(1, "u9"), (2, "c"), (3, "e")],
        "errors": [(1, "e")],
        "compactions": [(1, "z")],
        "first_user_messages": [(1, "u0")],
        "last_user_messages": [(1, "u9")],
    }
    selected = evidence.select_buckets(table(spark, rows), limits)
    assert evidence.distinct_selected(selected).first()["events_selected"] == 6


def test_the_rank_is_cut_before_the_shuffle(spark):
    plan = evidence.select_buckets(table(spark, [(ev.USER, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_trim(spark):
    rows = [
        (ev.TOOL_CALL, "x", "Read", ["/a/.env"], False, False),
        (ev.TOOL_CALL, "cat id_rsa", "exec"),
        (ev.TOOL_RESULT, "token=abcdef " + "y" * 2000),
        (ev.USER, "z" * 1999),
        (ev.METADATA, "token=abcdef"),
    ]
    got = evidence.trim(table(spark, rows)).orderBy("line_no").collect()
    assert got[0]["text"] == evidence.WITHHELD_FILE and got[1]["text"] == evidence.WITHHELD_CALL
    assert got[2]["text"].startswith("token=[REDACTED] yy") and got[2]["text"].endswith("\n[tool result truncated: original length 2017 chars]")
    assert got[3]["text"] == "z" * 1999 and got[4]["text"] == "token=abcdef"
    assert [r["redactions"] for r in got] == [0, 0, 1, 0, 0]


def test_stats(spark):
    rows = [(ev.METADATA, "x\ncwd: /w \n"), (ev.METADATA, "cwd: /late"), (ev.TOOL_CALL, "a", "B"), (ev.TOOL_CALL, "a", "A"), (ev.TOOL_CALL, "pwd=abcd", "A", ["p", "p"], False, True), (ev.TOOL_CALL, "a", "B", ["p"])]
    df = table(spark, rows)
    bad = spark.createDataFrame([("s", True), ("s", False), ("only bad", False)], "session_key string, ok boolean")
    got = {r["session_key"]: r for r in evidence.session_stats(evidence.trim(df), bad).collect()}
    s = got["s"]
    assert (s["total_events"], s["redactions"], s["session_cwd"], s["invalid_lines"]) == (6, 1, "/w", 1)
    assert [(t["tool"], t["n"]) for t in s["top_tools"]] == [("B", 2), ("A", 2)]  # of equals the first seen
    assert [(k["kind"], k["n"]) for k in s["event_kinds"]] == [("tool_call", 4), ("session_metadata", 2)]
    assert (got["only bad"]["total_events"], got["only bad"]["invalid_lines"]) == (0, 1)
    touched = evidence.touched_files(df).first()
    assert (touched["path"], touched["n"], touched["n_mutating"]) == ("p", 3, 2)


def test_settings(tmp_path):
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    assert Limits.of({"evidence": {"last_events": -5, "max_errors": "x", "first_events": "7"}}) == Limits(first_events=7, last_events=0)
    assert Limits(max_user_messages=0).user_messages == 1
    path = tmp_path / "c.json"
    path.write_text('{"evidence": {"max_errors": 3}}')
    assert Limits.of(load_config(str(path), {})).max_errors == 3
    path.write_text("{")
    import pytest

    with pytest.warns(UserWarning):
        assert Limits.of(load_config(str(path), {})) == Limits()
    assert not llm_ready(load_config(None, {}))
    assert llm_ready(deep_merge(load_config(None, {"SESSIONLOOM_LLM_BASE_URL": "http://x"}), {"llm": {"model": "m"}}))


def test_changes(spark):
    lines = ["?? new.txt", "UU both", "R  old -> moved", " D gone", "A  added", " M mod", '?? "sp ace"', "x"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, pos long")
    got = relevance.classify_status(df)
    assert {(r["path"], r["change_kind"]) for r in got.collect()} == {("new.txt", "untracked"), ("both", "conflicted"), ("moved", "renamed"), ("gone", "deleted"), ("added", "added"), ("mod", "modified"), ("sp ace", "untracked")}
    assert [r["path"] for r in relevance.changed_paths(got).orderBy("place").collect()] == ["mod", "added", "moved", "gone", "both", "new.txt", "sp ace"]
    touched = spark.createDataFrame([("s", "/r/mod", 2, 1), ("s", "/r/clean", 1, 2), ("s", "/tmp/x", 9, 3), ("s", "rel", 1, 4), ("s", "mod", 5, 5)], "session_key string, path string, n long, first long")
    rel = relevance.relative_touched(touched, "/r/")
    assert {(r["path"], r["n"]) for r in rel.collect()} == {("mod", 5), ("clean", 1), ("rel", 1)}
    own = relevance.changed_paths(got).withColumn("session_key", F.lit("s"))
    assert [(r["path"], r["touched"]) for r in relevance.changed_with_touched(own, rel, 2).orderBy("rank").collect()] == [("mod", True), ("added", False)]
    assert [r["path"] for r in relevance.touched_but_clean(rel, own).orderBy("rank").collect()] == ["clean", "rel"]


def test_discovery(spark):
    import pytest

    files = spark.createDataFrame([(f"/h/-r-x/{n}.jsonl", t, 1) for n, t in (("a", 3), ("b", 2), ("c", 1))], "session_key string, mtime long, size long")
    probes = spark.createDataFrame([("/h/-r-x/a.jsonl", "ida", "/elsewhere"), ("/h/-r-x/b.jsonl", "idb", "/r/x/sub"), ("/h/-r-x/c.jsonl", None, None)], "session_key string, session_id string, cwd string")
    found = discovery.discover(files, probes, "block", "/r/x")
    assert {(r["session_id"], r["match"]) for r in found.collect()} == {("ida", "foreign"), ("idb", "confirmed"), ("c", "hinted")}
    assert discovery.select_session(found)["session_id"] == "idb"
    assert discovery.select_session(found, "ID")["session_id"] == "ida"
    with pytest.raises(discovery.NoSession):
        discovery.select_session(found, "nope")
    with pytest.raises(discovery.NoSession, match="belong to other"):
        discovery.select_session(found.where("match = 'foreign'"))
    with pytest.raises(discovery.NoSession, match="there are no"):
        discovery.select_session(found.limit(0))
    near = discovery.discover(files, probes.limit(0), "block", "/r/x")
    assert [(r["note"], r["match"]) for r in near.distinct().select("note", "match").distinct().collect()] == [("its folder carries the repository's name", "hinted")]
    assert [r["session_key"] for r in discovery.newest(files, 2).collect()] == ["/h/-r-x/a.jsonl", "/h/-r-x/b.jsonl"]
    assert [r["session_id"] for r in discovery.ranked(found).collect()] == ["idb", "c"]
    counts = discovery.linked_counts(found).first()
    assert (counts["sessions"], counts["linked"]) == (3, 2)
    ids = spark.createDataFrame([("/x/rollout-2026-0a1b2c3d-0000-1111-2222-333344445555.jsonl",)], "p string")
    assert ids.select(discovery.session_id_of_path(F.col("p"), "rollout")).first()[0] == "0a1b2c3d-0000-1111-2222-333344445555"


def test_archive(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "name string, content string")
    assert archive.append_new(first, path).count() == 2
    again = spark.createDataFrame([("d", "x"), ("e", "z")], "name string, content string")
    assert [r["name"] for r in archive.append_new(again, path).collect()] == ["e"]
    assert spark.read.parquet(path).count() == 3
    names = spark.createDataFrame([("20260101-000000-block-abc.md",), ("20260102-000000-block-abc-2.md",), ("x.txt",)], "name string")
    got = archive.history(names, most=5).collect()
    assert [(r["generated"], r["session"], r["copy"]) for r in got] == [("20260102-000000", "abc", "2"), ("20260101-000000", "abc", "")]
