"""The rollout dialect: records with a typed payload, some turns recorded twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.classify import is_injected_context, is_mutating_tool, looks_failed, mutates_by_shell
from sessionloom.functions.text import is_blank, sha256_text, strip, ts_to_iso
from sessionloom.operators import events as ev
from sessionloom.shared import few_broadcast
from sessionloom.sources.jsonl import head_values, is_kind, json_text, list_at, object_at, scalar_at, string_at

AGENT = "rollout"
#: Lines and characters of a session's head.
HEAD = (60, 512 << 10)
# Types of calls and outputs, of text blocks, and a session's described keys.
CALLS = ("custom_tool_call", "function_call", "local_shell_call")
OUTPUTS = ("custom_tool_call_output", "function_call_output", "local_shell_call_output")
TEXT_TYPES = ("input_text", "output_text", "text", "Text")
IMAGE_TYPES = ("input_image", "image")
ITEMS = ("FileChange", "ContextCompaction", "Error", "McpToolCall", "UserMessage")
#: What an event's place is.
PLACE = ["session_key", "block_start", "line_no", "sub_no"]
META_KEYS = ("session_id", "cwd", "originator", "cli_version", "model_provider")


def inner_content(value: Column) -> Column:
    """An object's content, or its text if that is empty; other values as they are."""
    content = F.try_variant_get(value, "$.content", "variant")
    empty = content.isNull() | json_text(content).isin('""', "[]", "{}", "null", "0", "false")
    return F.when(is_kind(value, "OBJECT"), F.when(empty, F.try_variant_get(value, "$.text", "variant")).otherwise(content)).otherwise(value)


def flat_content(value: Column) -> Column:
    """Content that is no object as text: text itself, or the texts of a list."""

    def part(b: Column) -> Column:
        of = scalar_at(b, "$.type")
        return F.when(is_kind(b, "STRING"), string_at(b, "$")).when(of.isin(*TEXT_TYPES), scalar_at(b, "$.text")).when(of.isin(*IMAGE_TYPES), F.lit("[image omitted]"))

    listed = F.array_join(F.filter(F.transform(list_at(value, "$"), part), lambda p: p != ""), "\n")
    return F.when(is_kind(value, "STRING"), string_at(value, "$")).when(is_kind(value, "ARRAY"), listed).otherwise(scalar_at(value, "$"))


def _changed(changes: Column) -> Column:
    """The first 40 changes of files in the record's own order, each with its kind."""
    return F.array_join(
        F.transform(
            F.slice(F.map_entries(changes), 1, 40),
            lambda c: F.concat(F.coalesce(F.get_json_object(c["value"], "$.type"), F.when(c["value"].startswith("{"), F.lit("None")).otherwise(F.lit("change"))), F.lit(": "), c["key"]),
        ),
        "\n",
    )


def first_ids(lines: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """session_key, first_id and named_at: the first session id of each file and its place.

    Only lines whose text holds the key are parsed for it.
    """
    found = F.nullif(scalar_at(F.col("v"), "$.payload.session_id"), F.lit(""))
    rows = lines.where(F.col("raw").contains('"session_id"')).where("ok").select("session_key", F.struct("block_start", "line_no").alias("at"), found.alias("id")).where("id IS NOT NULL")
    if earlier is not None:
        rows = rows.unionByName(earlier.select("session_key", F.col("named_at").alias("at"), F.col("first_id").alias("id")))
    return rows.groupBy("session_key").agg(F.min_by("id", "at").alias("first_id"), F.min("at").alias("named_at"))


def normalize(lines: DataFrame, dedupe: bool = True, earlier: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Events of rollout-dialect lines (see `read_jsonl`).

    A line's session is the first one named so far in its file. A user's text
    that its session already has is dropped (`dedupe`), whichever kind of record
    holds it. Both are found first, from the few lines that can tell: session
    ids, and the places of repeats, go to the tasks that read the lines, so that
    no text is shuffled (ids and places beyond `FEW_ROWS` are joined instead).
    Where `lines` go on from lines that were read before, `earlier` holds the
    digests (see `user_digests`) and `named` the `first_ids` of those.
    """
    out = _events(lines)
    if dedupe:
        out = out.join(few_broadcast(repeats(user_digests(lines), earlier)), PLACE, "left_anti")
    out = out.join(few_broadcast(first_ids(lines, named)), "session_key", "left")
    since = F.struct("block_start", "line_no") >= F.col("named_at")
    return out.withColumn("session_id", F.when(since, F.col("first_id")).otherwise("")).select(*ev.COLUMNS)


def user_digests(lines: DataFrame) -> DataFrame:
    """Place and digest of each user message; of lines, only those that can hold one are parsed, and of those only the texts read."""
    get = lambda of, path: F.try_variant_get(of, path, "variant")
    v, p, item = F.col("v"), F.col("p"), F.col("item")
    rows = lines.where(F.col("ok") & F.col("raw").rlike('"user"|"UserMessage"')).withColumn("p", object_at(v, "$.payload"))
    rows = rows.select("session_key", "block_start", "line_no", "p", scalar_at(v, "$.type").alias("t"), scalar_at(p, "$.type").alias("pt"), object_at(p, "$.item").alias("item"))
    message = (F.col("t") == "response_item") & (F.col("pt") == "message") & (scalar_at(p, "$.role") == "user")
    turn = (F.col("t") == "event_msg") & (F.col("pt") == "item_completed") & (scalar_at(item, "$.type") == "UserMessage")
    rows = rows.withColumn("body", F.when(message, get(p, "$.content")).when(turn, get(item, "$.content")))
    for _ in range(2):
        rows = rows.withColumn("body", inner_content(F.col("body")))
    rows = rows.withColumn("text", flat_content(F.col("body")))
    text = F.col("text")
    # kept by a generator, as in `_events`
    heard = F.when(~is_blank(text) & ~is_injected_context(text), F.array(sha256_text(strip(text)))).otherwise(F.array().cast("array<string>"))
    return rows.select("session_key", "block_start", "line_no", F.lit(0).alias("sub_no"), F.explode(heard).alias("digest"))


def digested(users: DataFrame) -> DataFrame:
    return users.select(*PLACE, sha256_text(strip(F.col("text"))).alias("digest"))


def _events(lines: DataFrame) -> DataFrame:
    """Events of lines, each by itself; no session is named."""
    v, p, item, what, body = (F.col(c) for c in ("v", "p", "item", "what", "body"))
    t, pt = F.col("t"), F.col("pt")
    # each step's columns are used several times by the next, and computed once
    rows = lines.where("ok").withColumn("p", object_at(v, "$.payload")).where(p.isNotNull())
    rows = rows.select("session_key", "block_start", "line_no", "v", "p", "raw", scalar_at(v, "$.type").alias("t"), scalar_at(p, "$.type").alias("pt"))
    # what a line is; a line gives one event at most
    of_response = F.when(pt == "message", "message").when(pt.isin(*CALLS), "call").when(pt.isin(*OUTPUTS), "output")
    rows = rows.withColumn("item", F.when((t == "event_msg") & (pt == "item_completed"), object_at(p, "$.item")))
    rows = rows.withColumn("what", F.when(t.isin("session_meta", "compacted"), t).when(t == "response_item", of_response).otherwise(F.nullif(scalar_at(item, "$.type"), F.lit(""))))
    rows = rows.withColumn("known", F.coalesce(what.isin("session_meta", "compacted", "message", "call", "output", *ITEMS), F.lit(False)))

    get = lambda of, path: F.try_variant_get(of, path, "variant")
    content = F.when(what == "message", get(p, "$.content")).when(what == "output", get(p, "$.output")).when(what == "UserMessage", get(item, "$.content")).when(what == "Error", F.coalesce(get(item, "$.message"), get(item, "$.content")))
    rows = rows.withColumn("body", content)
    for _ in range(2):
        rows = rows.withColumn("body", inner_content(body))
    given = F.coalesce(get(p, "$.input"), get(p, "$.arguments"))
    history = F.size(list_at(p, "$.replacement_history"))
    kept = F.when(history >= 0, F.format_string("context compaction: history replaced with %d retained item(s)", history)).otherwise("")
    text = (
        F.when(what.isin("message", "output", "UserMessage", "Error"), flat_content(body))
        .when(what == "call", F.when(is_kind(given, "STRING"), string_at(given, "$")).otherwise(F.coalesce(json_text(given), F.lit("null"))))
        .when(what == "compacted", F.coalesce(F.nullif(scalar_at(p, "$.message"), F.lit("")), kept))
        .when(what == "session_meta", F.concat_ws("\n", *[F.when(F.col(f"meta_{k}") != "", F.concat(F.lit(f"{k}: "), F.col(f"meta_{k}"))) for k in META_KEYS]))
        .when(what == "ContextCompaction", "context compaction performed by the agent")
        .when(what == "McpToolCall", scalar_at(item, "$.title"))
        .when(what == "FileChange", _changed(F.col("changes")))
    )
    rows = rows.withColumns({f"meta_{k}": F.when(what == "session_meta", scalar_at(p, f"$.{k}")) for k in META_KEYS})
    # a VARIANT sorts an object's keys, the line's text has them as they were written
    changes = F.when((what == "FileChange") & object_at(item, "$.changes").isNotNull(), F.from_json(F.get_json_object("raw", "$.payload.item.changes"), "map<string,string>"))
    rows = rows.withColumns({"changes": changes, "said_by": F.when(what == "message", scalar_at(p, "$.role"))}).withColumn("text", text)
    text, role, asked = F.col("text"), F.col("said_by"), (what == "UserMessage") | ((what == "message") & (F.col("said_by") == "user"))
    silent = F.when(what == "message", (role == "developer") | is_blank(text)).when(what == "UserMessage", is_blank(text)).when(what == "FileChange", F.col("changes").isNull()).otherwise(False)
    rows = rows.withColumn("failed", F.when(what == "output", looks_failed(text)).otherwise(what == "Error"))
    # kept by a generator: a filter would be pushed below all the steps and repeat them
    heard = F.col("known") & ~silent & ~F.when(asked, is_injected_context(text)).otherwise(False)

    server = F.coalesce(F.nullif(scalar_at(item, "$.server"), F.lit("")), F.lit("mcp"))
    tool = F.coalesce(F.nullif(scalar_at(item, "$.tool"), F.lit("")), F.lit("?"))
    named = F.when(what == "call", F.coalesce(F.nullif(scalar_at(p, "$.name"), F.lit("")), pt)).when(what == "FileChange", "FileChange").when(what == "McpToolCall", F.concat(server, F.lit("/"), tool))
    kind = (
        F.when(what == "session_meta", ev.METADATA)
        .when(what.isin("compacted", "ContextCompaction"), ev.COMPACTION)
        .when(asked, ev.USER)
        .when(what == "message", ev.ASSISTANT)
        .when(what.isin("call", "FileChange", "McpToolCall"), ev.TOOL_CALL)
        .otherwise(F.when(F.col("failed"), ev.TOOL_ERROR).otherwise(ev.TOOL_RESULT))
    )
    paths = F.when(what == "FileChange", F.map_keys("changes")).otherwise(F.array().cast("array<string>"))
    raw = F.when(what.isin("session_meta", "compacted"), t).when(t == "response_item", F.concat_ws("/", t, pt)).otherwise(F.concat(t, F.lit("/item/"), what))
    mutating = F.when(what == "call", is_mutating_tool(F.col("tool")) | mutates_by_shell(text)).otherwise(what == "FileChange")
    rows = rows.withColumns({"call": F.when(what.isin("call", "output"), scalar_at(p, "$.call_id")), "tool": named, "session_id": F.lit(""), "ts_raw": ts_to_iso(get(v, "$.timestamp"))})
    spoken = F.when(what == "UserMessage", "user").otherwise(role)
    return ev.table(rows, AGENT, ev.one(ev.event(kind, text, raw, spoken, F.col("tool"), paths, F.col("failed"), mutating, F.col("call")), heard))


def repeats(digests: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Places of user messages whose stripped text the session already had; only digests are shuffled."""
    rows = digests if earlier is None else digests.unionByName(earlier.select(digests.columns))
    order = Window.partitionBy("session_key", "digest").orderBy("block_start", "line_no", "sub_no")
    return rows.withColumn("n", F.row_number().over(order)).where("n > 1").select(*PLACE)


def first_of_repeats(events: DataFrame) -> DataFrame:
    """Events without the user messages whose stripped text the session already had."""
    return events.join(few_broadcast(repeats(digested(events.where(F.col("kind") == ev.USER)))), PLACE, "left_anti")


def probe(lines: DataFrame) -> DataFrame:
    """session_key, session_id and cwd from each session's head; an id must be hexadecimal."""
    v = F.col("v")
    found = F.coalesce(F.nullif(scalar_at(v, "$.payload.session_id"), F.lit("")), scalar_at(v, "$.payload.id"))
    cwd = F.coalesce(F.nullif(scalar_at(v, "$.payload.cwd"), F.lit("")), string_at(v, "$.payload.workspace_roots[0]"))
    rows = head_values(lines, *HEAD, {"session_id": found, "cwd": cwd})
    return rows.withColumn("session_id", F.when(F.col("session_id").rlike("^[0-9a-fA-F-]{8,}$"), F.col("session_id")))
