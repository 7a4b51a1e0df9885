import pytest
from pyspark.sql import functions as F

from sessionloom.functions import classify, redact, text


def values(spark, f, rows, schema="t string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(f(F.col("t")).alias("x")).collect()]





def test_truncate(spark):
    got = values(spark, lambda T: text.truncate_text(T, 5, "tool result"), ["abcd   efgh", "abc", "", None])
    assert got == ["abcd\n[tool result truncated: original length 11 chars]", "abc", "", ""]
    assert values(spark, lambda T: text.truncate_text(T, 0), ["x" * 50]) == ["x" * 50]


def test_strip_is_unicode(spark):
    assert values(spark, lambda T: text.strip(T), ["\u00a0 a\u3000", "b\n"]) == ["a", "b"]


def test_names(spark):
    assert values(spark, lambda T: text.safe_component(T), ["a/b c", "..", "", None, "_x_"]) == ["a_b_c", "unknown", "unknown", "unknown", "x"]
    assert values(spark, lambda T: text.path_slug(T), ["/a/b_c"]) == ["-a-b-c"]
    assert values(spark, lambda T: text.name_slug(T), ["My  Repo!", "__"]) == ["my-repo", "project"]
    assert values(spark, lambda T: text.short_id(T), ["0123456789", "", None]) == ["01234567", "unknown", "unknown"]
    assert values(spark, lambda T: text.short_head(T), ["a" * 40, "(no commits yet)", None]) == ["a" * 12, "(no commits yet)", "unknown"]


def test_paths(spark):
    assert values(spark, lambda T: text.normalize_path(T), ["C:\\A\\", "/a/b//", "/", None, " x "]) == ["c:/a", "/a/b", "/", "", "x"]
    assert values(spark, lambda T: text.path_is_within(T, F.lit("/r")), ["/r", "/r/x", "/rx", "", None]) == [True, True, False, False, False]


def test_sizes(spark):
    got = values(spark, lambda T: text.human_size(T), [0, 1023, 1024, 1280, 5 * 2**20, 2**50], "t long")
    assert got == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "5.0 MiB", "1024.0 TiB"]


def test_times(spark):
    rows = ['"2026-09-09T10:00:00.5Z"', '"2026-09-09T10:00:00"', "1757412000", "1757412000000", '"soon"', "null", "true", '" "']
    got = values(spark, lambda T: text.ts_to_iso(F.parse_json(T)), rows)
    assert got == ["2026-09-09T10:00:00+00:00", "2026-09-09T10:00:00+00:00", "2025-09-09T10:00:00+00:00", "2025-09-09T10:00:00+00:00", "soon", None, None, None]


def test_head_tail_keeps_to_its_budget(spark):
    long = "h" * 3000 + "t" * 3000
    for budget in (0, 10, 44, 45, 46, 100, 1000, 1990, 2044, 2045, 2200, 5000):
        got = values(spark, lambda T: text.head_tail(T, budget), [long])[0]
        assert len(got) <= budget and got[:1] == "h"[:budget]
    assert values(spark, lambda T: text.head_tail(T, 5000), [long])[0].endswith("t" * 1000)
    assert values(spark, lambda T: text.head_tail(T, 9000), [long]) == [long]
    assert values(spark, lambda T: text.collapse_blank_lines(T), ["a\n\n\n\nb"]) == ["a\n\nb"]


SECRETS = [
    "sk-ant-" + "a" * 12, "sk-" + "b" * 16, "ghp_" + "c" * 20, "github_pat_" + "d" * 20, "xoxb-" + "1" * 10,
    "AKIA" + "A" * 16, "AIza" + "e" * 30, "eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
]


def test_redaction_families(spark):
    got = values(spark, lambda T: redact.scrub(T), SECRETS)
    assert [(r["text"], r["hits"]) for r in got] == [(redact.MARK, 1)] * len(SECRETS)
    rows = ["Authorization: Bearer abc", "Set-Cookie: a=b; c", 'password = "hunter22"', "API_KEY:abcd", "the token is lost", "pwd=abc", None]
    got = values(spark, lambda T: redact.scrub(T), rows)
    assert [r["text"] for r in got] == ["Authorization: [REDACTED]", "Set-Cookie: [REDACTED] c", 'password = "[REDACTED]"', "API_KEY:[REDACTED]", "the token is lost", "pwd=abc", ""]
    assert [r["hits"] for r in got] == [1, 1, 1, 1, 0, 0, 0]


def test_redaction_counts_what_the_last_step_left(spark):
    # the value of a key is taken by its key, not counted again by its own shape
    got = values(spark, lambda T: redact.scrub(T), ["token=ghp_" + "c" * 20 + " ghp_" + "d" * 20])
    assert (got[0]["text"], got[0]["hits"]) == ("token=[REDACTED] [REDACTED]", 2)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("<system-note>x</system-note>", True), (" <a-b>x</a-b><c-d>y</c-d> short", True), ("<abc>" + "x", True), ("<abc>x</abc>" + "y" * 40, False), ("hello", False), (None, False), ("", False)],
)
def test_injected(spark, given, expected):
    assert values(spark, lambda T: classify.is_injected_context(T), [given]) == [expected]


def test_tools(spark):
    assert values(spark, lambda T: classify.is_mutating_tool(T), ["Edit", "Read", "credit_lookup", "apply_patch", None]) == [True, False, True, True, False]
    assert values(spark, lambda T: classify.mutates_by_shell(T), ["echo a >> b", "ls > x", "Set-Content f", None]) == [True, False, True, False]
    assert values(spark, lambda T: classify.looks_failed(T), ['{"exit_code": 2}', '{"exit_code": 0}', "ok\nExit code: 1", "Traceback (most recent call last): x", "x" * 1500 + "fatal error", None]) == [True, False, True, False, False, False]


def test_credentials(spark):
    rows = ["/a/.env", "C:\\x\\id_rsa.pub", "a/key.pem", "my-credentials.txt", "/a/.envrc", "a/environment", "", None]
    assert values(spark, lambda T: classify.is_credential_path(T), rows) == [True, True, True, True, False, False, False, False]


def test_session_match(spark):
    got = values(spark, lambda T: classify.session_match(T, F.lit("/r/x"), F.lit(True)), ["/r/x/y", "/r", "/q", None])
    assert got == ["confirmed", "confirmed", "foreign", "hinted"]
    assert values(spark, lambda T: classify.session_match(T, F.lit("/r"), F.lit(False)), [None]) == ["unknown"]
