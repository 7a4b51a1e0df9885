"""The patch dialect: a log of messages, replacements and rewinds that is replayed to its last state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.classify import is_injected_context, looks_failed, tool_mutates
from sessionloom.functions.text import strip, ts_to_iso
from sessionloom.operators import events as ev
from sessionloom.shared import importable
from sessionloom.sources.jsonl import head_values, is_kind, json_text, kind, list_at, object_at, scalar_at, string_at

AGENT = "patch"
#: Lines and characters of a log's head.
HEAD = (5, 64 << 10)
# Argument keys that describe a call, and those that hold paths; a reply that says nothing.
ARG_KEYS = ("file_path", "path", "absolute_path", "old_path", "new_path", "old_string", "new_string", "command", "pattern", "query", "url")
PATH_KEYS = ("file_path", "path", "absolute_path", "old_path", "new_path")
ACKNOWLEDGED = "Got it. Thanks for the additional context!"

#: Operations in a log's order of precedence.
REWIND, REPLACE, UPSERT = "rewind", "replace", "upsert"


def operations(lines: DataFrame) -> DataFrame:
    """session_key, block_start, line_no, op, id (of a rewind), ids and messages: what each line does to the message list."""
    v = F.col("v")
    rows = lines.where("ok").select(
        "session_key",
        "block_start",
        "line_no",
        "v",
        string_at(v, "$['$rewindTo']").alias("rewind"),
        object_at(v, "$['$set']").alias("update"),
        (string_at(v, "$.sessionId").isNotNull() & string_at(v, "$.projectHash").isNotNull()).alias("header"),
        string_at(v, "$.id").isNotNull().alias("named"),
    )
    rewind, update, header, named = (F.col(c) for c in ("rewind", "update", "header", "named"))
    listed = F.when(update.isNotNull(), list_at(update, "$.messages")).when(header, list_at(v, "$.messages")).when(named, F.array(v))
    rows = rows.withColumn("listed", F.when(rewind.isNull(), listed))
    op = F.when(rewind.isNotNull(), REWIND).when(update.isNotNull(), F.when(F.col("listed").isNotNull(), REPLACE)).when(header | named, UPSERT)
    done = F.struct(op.alias("op"), rewind.alias("id"))
    rows = rows.select("session_key", "block_start", "line_no", "listed", F.explode(F.filter(F.array(done), lambda x: x["op"].isNotNull())).alias("x"))
    # ids stand by themselves too, so that what needs no message carries none
    listed = F.filter(F.coalesce("listed", F.array().cast("array<variant>")), lambda m: string_at(m, "$.id").isNotNull())
    ids = F.transform(listed, lambda m: string_at(m, "$.id"))
    messages = F.transform(listed, lambda m: F.struct(string_at(m, "$.id").alias("id"), m.alias("m")))
    return rows.select("session_key", "block_start", "line_no", "x.*", ids.alias("ids"), messages.alias("messages"))


class Live:
    """The messages that are live after the operations so far, as (id, place), in order. Each step costs what it changes."""

    def __init__(self):
        self.order: list[tuple[str, tuple]] = []
        self.at: dict[str, int] = {}

    def upsert(self, id_: str, place: tuple) -> None:
        """A known id keeps its place in the order; others go to the end."""
        at = self.at.setdefault(id_, len(self.order))
        self.order[at : at + 1] = [(id_, place)]

    def rewind(self, id_: str | None) -> None:
        """Only what stands before that id stays; nothing if it is unknown."""
        for gone, _ in self.order[self.at.get(id_, 0) :]:
            del self.at[gone]
        del self.order[len(self.at) :]

    def apply(self, op: str, id_: str | None, messages: list[tuple[str, tuple]]) -> None:
        if op in (REWIND, REPLACE):
            self.rewind(id_ if op == REWIND else None)
        for message in messages:
            self.upsert(*message)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logs one after the other, each in order; holds the live ids and places of one log, and no message."""
    key, live = None, Live()

    def out() -> pa.RecordBatch:
        n = len(live.order)
        places = [place for _, place in live.order]
        columns = [pa.array([key] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([i for i, _ in live.order], pa.string())]
        columns += [pa.array([p[k] for p in places], pa.int64() if k < 2 else pa.int32()) for k in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["session_key", "pos", "id", "block_start", "line_no", "item"])

    for batch in batches:
        for of, block, line, op, id_, ids in zip(*(batch.column(c).to_pylist() for c in ("session_key", "block_start", "line_no", "op", "id", "ids")), strict=True):
            if of != key:
                yield out()
                key, live = of, Live()
            live.apply(op, id_, [(m, (block, line, k)) for k, m in enumerate(ids)])
    yield out()


def live_messages(ops: DataFrame) -> DataFrame:
    """session_key, pos, id, block_start, line_no and v (VARIANT) of the messages that are left after all operations.

    Ids and places of operations are dealt by log, sorted by Spark, and folded
    as they come, in time linear in the log; the messages themselves are joined
    to the places that are left.
    """
    importable(ops.sparkSession)
    told = ops.select("session_key", "block_start", "line_no", "op", "id", "ids")
    sorted_ = told.repartition("session_key").sortWithinPartitions("session_key", "block_start", "line_no")
    live = sorted_.mapInArrow(_folded, "session_key string, pos int, id string, block_start long, line_no long, item int")
    bodies = ops.select("session_key", "block_start", "line_no", F.posexplode("messages").alias("item", "m")).select("session_key", "block_start", "line_no", "item", F.col("m.m").alias("v"))
    # Spark guesses their size from the file's, whatever lists and values hold, and would broadcast millions
    return live.join(bodies.hint("merge"), ["session_key", "block_start", "line_no", "item"]).select("session_key", "pos", "id", "block_start", "line_no", "v")


def replay(ops: DataFrame) -> DataFrame:
    """`live_messages`, each as JSON in `body`."""
    return live_messages(ops).select("session_key", "pos", "id", "block_start", "line_no", json_text(F.col("v")).alias("body"))


def parts_of(v: Column, path: str) -> Column:
    """Content as a list of parts: text becomes one text part."""
    value = F.try_variant_get(v, path, "variant")

    def wrap(x: Column) -> Column:
        return F.parse_json(F.to_json(F.struct(scalar_at(x, "$").alias("text"))))

    none = F.array().cast("array<variant>")
    listed = F.transform(list_at(value, "$"), lambda x: F.when(is_kind(x, "OBJECT"), x).otherwise(wrap(x)))
    text = F.when(string_at(value, "$") == "", none).otherwise(F.array(wrap(value)))
    return F.when(is_kind(value, "ARRAY"), listed).when(is_kind(value, "OBJECT"), F.array(value)).when(value.isNull() | kind(value).isin("VOID", ""), none).otherwise(text)


def visible_text(parts: Column) -> Column:
    """The texts of parts that are no thoughts."""
    thought = lambda x: F.coalesce(F.try_variant_get(x, "$.thought", "boolean"), F.lit(False))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.when(~thought(x), scalar_at(x, "$.text"))), lambda t: t != ""), "\n")


def describe_args(args: Column) -> Column:
    shown = json_text(args)
    fallback = F.when(args.isNull() | shown.isin("{}", "[]", '""', "null", "0", "false"), F.lit("")).otherwise(F.left(shown, F.lit(800)))
    return ev.described(args, ARG_KEYS, lambda k: string_at(args, f"$.{k}"), fallback)


def paths_of_args(args: Column) -> Column:
    found = F.array(*[strip(string_at(args, f"$.{k}")) for k in PATH_KEYS])
    return F.filter(found, lambda p: p.isNotNull() & (p != ""))


def flatten_result(value: Column) -> Column:
    """A tool's result as text: its output if it names one, else its JSON of 2000 characters."""
    shown = F.left(json_text(value), F.lit(2000))
    listed = F.coalesce(F.nullif(visible_text(parts_of(value, "$")), F.lit("")), shown)
    whole = F.coalesce(string_at(value, "$.output"), string_at(value, "$.response.output"), shown)
    return F.when(is_kind(value, "STRING"), string_at(value, "$")).when(is_kind(value, "ARRAY"), listed).when(is_kind(value, "OBJECT"), whole).otherwise(scalar_at(value, "$"))


def _piece(which: str, name: Column | None = None, value: Column | None = None, call: Column | None = None) -> Column:
    name = F.lit(None).cast("string") if name is None else name
    value = F.lit(None).cast("variant") if value is None else value
    call = F.lit(None).cast("string") if call is None else F.nullif(call, F.lit(""))
    return F.struct(F.lit(which).alias("which"), name.alias("name"), value.alias("value"), call.alias("call"))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows (v, raw) as one row for each thing that a message says, calls or answers, in order: sub_no, which, name, value, call, said.

    Things come out of the message before they are described, so that each is
    described by columns of its own row.
    """
    v, raw, parts = F.col("v"), F.col("raw"), F.col("parts")
    get = lambda of, path: F.try_variant_get(of, path, "variant")
    rows = rows.withColumn("parts", parts_of(v, "$.content")).withColumn("said", visible_text(parts))
    answers = F.filter(parts, lambda x: object_at(x, "$.functionResponse").isNotNull())
    answered = F.transform(answers, lambda x: _piece("result", string_at(x, "$.functionResponse.name"), get(x, "$.functionResponse.response"), scalar_at(x, "$.functionResponse.id")))
    calls = F.filter(F.transform(parts, lambda x: object_at(x, "$.functionCall")), lambda c: c.isNotNull())
    called = F.transform(calls, lambda c: _piece("call", scalar_at(c, "$.name"), get(c, "$.args"), scalar_at(c, "$.id")))
    tools = F.filter(F.coalesce(list_at(v, "$.toolCalls"), F.array().cast("array<variant>")), lambda c: is_kind(c, "OBJECT"))
    # a call and its result stand in one record; without an id they are known by the message and their place in it
    own = lambda c, i: F.coalesce(F.nullif(scalar_at(c, "$.id"), F.lit("")), F.concat(scalar_at(v, "$.id"), F.lit("#"), i.cast("string")))
    used = F.flatten(F.transform(tools, lambda c, i: F.array(_piece("call", scalar_at(c, "$.name"), get(c, "$.args"), own(c, i)), _piece("result", scalar_at(c, "$.name"), get(c, "$.result"), own(c, i)))))
    used = F.filter(used, lambda x: (x["which"] == "call") | (x["value"].isNotNull() & (kind(x["value"]) != "VOID")))
    user = F.when(F.size(answers) > 0, answered).otherwise(F.array(_piece("user")))
    found = F.when(raw == "error", F.array(_piece("error"))).when(raw == "user", user).when(raw.isin("gemini", "model"), F.concat(F.array(_piece("model")), called, used))
    rows = rows.withColumn("found", found)
    kept = [c for c in rows.columns if c not in ("v", "parts", "found")]
    return rows.select(*kept, F.posexplode("found").alias("sub_no", "x")).select(*kept, "sub_no", "x.*")


def described_pieces(rows: DataFrame) -> DataFrame:
    """The events of `pieces`, as the column e; what says nothing is left out."""
    which, raw, name, value, said = (F.col(c) for c in ("which", "raw", "name", "value", "said"))
    text = F.when(which == "call", describe_args(value)).when(which == "result", flatten_result(value)).otherwise(said)
    rows = rows.withColumn("text", text).withColumn("trimmed", F.when(which.isin("user", "model"), strip(said)))
    text, trimmed = F.col("text"), F.col("trimmed")
    rows = rows.withColumn("failed", F.when(which == "result", looks_failed(text)).otherwise(which == "error"))
    snapshot = (which == "user") & F.left(trimmed, F.lit(64)).contains("<state_snapshot>")
    ignored = (trimmed == "") | trimmed.rlike("^(/|\\?|<session_context>|<hook_context>)") | is_injected_context(said)
    heard = F.when(which == "user", snapshot | ~ignored).when(which == "model", (trimmed != "") & (trimmed != ACKNOWLEDGED)).otherwise(True)
    kinds = (
        F.when(which == "call", ev.TOOL_CALL)
        .when(which.isin("result", "error"), F.when(F.col("failed"), ev.TOOL_ERROR).otherwise(ev.TOOL_RESULT))
        .when(which == "model", ev.ASSISTANT)
        .otherwise(F.when(snapshot, ev.COMPACTION).otherwise(ev.USER))
    )
    role = F.when(which == "model", "model").when((which == "user") & ~snapshot, "user")
    paths = F.when(which == "call", paths_of_args(value)).otherwise(F.array().cast("array<string>"))
    mutating = F.when(which == "call", tool_mutates(name, text)).otherwise(False)
    e = ev.event(kinds, text, raw, role, name, paths, F.col("failed"), mutating, F.col("call"))
    kept = [c for c in rows.columns if c not in ("which", "raw", "name", "value", "call", "said", "text", "trimmed", "failed")]
    return rows.select(*kept, F.explode(ev.one(e, heard)).alias("e"))


def scratchpad(lines: DataFrame) -> DataFrame:
    """(session_key, block_start, line_no, note, stale): each log's last saved note, if it is not empty.

    It is stale if a message or a rewind follows.
    """
    v = F.col("v")
    update = object_at(v, "$['$set']")
    value = F.try_variant_get(update, "$.memoryScratchpad", "variant")
    rewind = string_at(v, "$['$rewindTo']").isNotNull()
    header = string_at(v, "$.sessionId").isNotNull() & string_at(v, "$.projectHash").isNotNull()
    # a key that holds null counts as saved, and as empty
    saves = ~rewind & update.isNotNull() & F.array_contains(F.json_object_keys(json_text(update)), "memoryScratchpad")
    moves = rewind | (~saves & update.isNull() & ~header & string_at(v, "$.id").isNotNull())
    empty = value.isNull() | json_text(value).isin('""', "[]", "{}", "null", "0", "false")
    note = F.when(~empty, F.when(is_kind(value, "STRING"), string_at(value, "$")).otherwise(json_text(value)))
    at = F.struct("block_start", "line_no")
    rows = lines.where("ok").select("session_key", at.alias("at"), saves.alias("saves"), moves.alias("moves"), note.alias("note"))
    rows = rows.where("saves OR moves").groupBy("session_key").agg(
        F.max_by(F.struct("at", "note"), F.when(F.col("saves"), F.col("at"))).alias("last"),
        F.max(F.when(F.col("moves"), F.col("at"))).alias("moved"),
    )
    rows = rows.where(F.col("last.note").isNotNull())
    return rows.select("session_key", "last.at.*", F.col("last.note").alias("note"), F.coalesce(F.col("moved") > F.col("last.at"), F.lit(False)).alias("stale"))


def normalize(lines: DataFrame) -> DataFrame:
    """Events of the messages that are live at the end of each log, in their final order, then its saved note.

    line_no is the message's final place and block_start 0, since a rewritten
    message keeps its place, not its line.
    """
    v = F.col("v")
    named = F.when(string_at(v, "$.projectHash").isNotNull(), string_at(v, "$.sessionId"))
    at = F.when(F.nullif(named, F.lit("")).isNotNull(), F.struct("block_start", "line_no"))
    ids = lines.where("ok").groupBy("session_key").agg(F.coalesce(F.min_by(named, at), F.lit("")).alias("session_id"))
    live = live_messages(operations(lines)).join(ids, "session_key", "left")
    rows = live.select("session_key", "session_id", F.lit(0).cast("long").alias("block_start"), F.col("pos").cast("long").alias("line_no"), "v", scalar_at(v, "$.type").alias("raw"), ts_to_iso(F.try_variant_get(v, "$.timestamp", "variant")).alias("ts_raw"))
    out = described_pieces(pieces(rows)).withColumn("agent", F.lit(AGENT)).withColumn("ts", F.col("ts_raw").try_cast("timestamp"))
    out = out.select("agent", "session_key", "session_id", "block_start", "line_no", "sub_no", "ts_raw", "ts", "e.*").select(*ev.COLUMNS)
    fresh = F.when(F.col("stale"), "possibly stale - the conversation continued after it was last saved").otherwise("fresh as of the most recent message")
    text = F.concat(F.lit("Saved scratchpad of the agent ("), fresh, F.lit("). It is evidence, not fact.\n\n"), F.col("note"))
    notes = scratchpad(lines).join(ids, "session_key", "left").select("session_key", "session_id", F.lit(1).cast("long").alias("block_start"), F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("string").alias("ts_raw"), text.alias("t"))
    return out.unionByName(ev.table(notes, AGENT, ev.one(ev.event(ev.COMPACTION, F.col("t"), F.lit("memoryScratchpad"), tool=F.lit("memory-scratchpad")))))


def probe(lines: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """session_key and session_id from each log's head, and cwd from the marker of its project.

    markers: (project, cwd), the folder that holds the chats and its marker's text.
    """
    v = F.col("v")
    found = head_values(lines, *HEAD, {"session_id": string_at(v, "$.sessionId")})
    project = F.regexp_extract(F.regexp_replace("session_key", "^file:/+", "/"), "^(.*)/[^/]+/[^/]+$", 1)
    if markers is None:
        return found.withColumn("cwd", F.lit(None).cast("string"))
    return found.withColumn("project", project).join(markers.select("project", F.nullif(strip(F.col("cwd")), F.lit("")).alias("cwd")), "project", "left").drop("project")
