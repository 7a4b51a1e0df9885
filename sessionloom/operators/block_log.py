"""The block dialect: messages whose content is text or a list of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.classify import is_injected_context, is_mutating_tool
from sessionloom.functions.text import is_blank, strip, ts_to_iso
from sessionloom.operators import events as ev
from sessionloom.sources.jsonl import head_values, is_kind, json_text, list_at, object_at, scalar_at, string_at

AGENT = "block"
#: Lines and characters of a session's head.
HEAD = (200, 512 << 10)
# The input keys that describe a call, and those that hold paths.
INPUT_KEYS = ("command", "file_path", "path", "pattern", "notebook_path", "url", "query", "description", "prompt", "old_string", "new_string")
PATH_KEYS = ("file_path", "path", "notebook_path", "filePath")


def describe_input(name: Column, value: Column) -> Column:
    """A call's input as `key: value` lines, else as JSON of 800 characters, else the tool's name."""
    shown = json_text(value)
    fallback = F.when(value.isNull() | (shown == "{}"), name).otherwise(F.left(shown, F.lit(800)))
    return ev.described(value, INPUT_KEYS, lambda k: strip(string_at(value, f"$.{k}")), fallback)


def paths_of_input(value: Column) -> Column:
    """Paths that a call names: four keys in order, then those of its first 20 edits."""
    own = F.array(*[strip(string_at(value, f"$.{k}")) for k in PATH_KEYS])
    own = F.filter(own, lambda p: p.isNotNull() & (p != ""))
    edits = F.coalesce(F.slice(list_at(value, "$.edits"), 1, 20), F.array().cast("array<variant>"))
    more = F.transform(edits, lambda e: F.coalesce(F.nullif(string_at(e, "$.file_path"), F.lit("")), string_at(e, "$.path")))
    return F.concat(own, F.filter(more, lambda p: p.isNotNull()))


def flatten_result(value: Column) -> Column:
    """A result as text: text itself, the texts of a list, an object's text or its JSON of 4000 characters."""

    def part(b: Column) -> Column:
        return F.when(is_kind(b, "STRING"), string_at(b, "$")).when(string_at(b, "$.type") == "text", scalar_at(b, "$.text")).when(string_at(b, "$.type") == "image", F.lit("[image omitted]"))

    parts = F.transform(list_at(value, "$"), part)
    listed = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    whole = F.when(string_at(value, "$.type") == "text", scalar_at(value, "$.text")).otherwise(F.left(json_text(value), F.lit(4000)))
    return F.when(is_kind(value, "STRING"), string_at(value, "$")).when(is_kind(value, "ARRAY"), listed).when(is_kind(value, "OBJECT"), whole).otherwise(scalar_at(value, "$"))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows (v, raw_type) as one row for each thing that a line holds, in order: sub_no, which and b, a block or the line itself.

    Blocks come out of the line before they are described, so that each is
    described by columns of its own row.
    """
    v, raw = F.col("v"), F.col("raw_type")
    whole = lambda which: F.array(F.struct(F.lit(which).alias("which"), v.alias("b")))
    listed = F.transform(list_at(v, "$.message.content"), lambda b: F.struct(F.lit("block").alias("which"), b.alias("b")))
    found = F.when(raw == "summary", whole("summary")).when(raw == "system", whole("boundary")).when(is_kind(v, "STRING", "$.message.content"), whole("plain")).otherwise(listed)
    kept = [c for c in rows.columns if c != "v"]
    return rows.select(*kept, F.posexplode(found).alias("sub_no", "x")).select(*kept, "sub_no", "x.*")


def normalize(lines: DataFrame) -> DataFrame:
    """Events of block-dialect lines (see `read_jsonl`); a line gives none, one or one for each block.

    An injected message is dropped only from a list of blocks, not where the
    content is plain text. sub_no is a block's place in its line.
    """
    v, raw, b, which = (F.col(c) for c in ("v", "raw_type", "b", "which"))
    rows = lines.where("ok").select("session_key", "block_start", "line_no", "v", scalar_at(v, "$.type").alias("raw_type"), scalar_at(v, "$.sessionId").alias("session_id"), ts_to_iso(F.try_variant_get(v, "$.timestamp", "variant")).alias("ts_raw"))
    rows = rows.where(raw.isin("user", "assistant", "summary") | ((raw == "system") & (string_at(v, "$.subtype") == "compact_boundary")))
    compact = F.coalesce(F.try_variant_get(v, "$.isCompactSummary", "boolean"), F.lit(False))
    rows = rows.withColumn("role", F.coalesce(F.nullif(scalar_at(v, "$.message.role"), F.lit("")), raw)).withColumn("compact", compact)
    rows = pieces(rows)
    # each step's columns are used several times by the next, and computed once
    rows = rows.withColumn("of", F.when(which == "block", string_at(b, "$.type")).otherwise(which))
    of, role, compact = F.col("of"), F.col("role"), F.col("compact")
    rows = rows.where(of.isin("text", "tool_use", "tool_result", "summary", "boundary", "plain"))
    call, result = of == "tool_use", of == "tool_result"
    meta = object_at(b, "$.compactMetadata")
    rows = rows.withColumns({
        "name": F.when(call, scalar_at(b, "$.name")),
        "input": F.when(call, object_at(b, "$.input")),
        "failed": result & F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)),
        "call": F.when(call, scalar_at(b, "$.id")).when(result, scalar_at(b, "$.tool_use_id")),
    })
    text = (
        F.when(of == "text", scalar_at(b, "$.text"))
        .when(call, describe_input(F.col("name"), F.col("input")))
        .when(result, flatten_result(F.try_variant_get(b, "$.content", "variant")))
        .when(of == "plain", string_at(b, "$.message.content"))
        .when(of == "summary", F.coalesce(F.nullif(scalar_at(b, "$.summary"), F.lit("")), scalar_at(b, "$.text")))
        .otherwise(F.when(meta.isNull() | (json_text(meta) == "{}"), F.lit("compaction boundary")).otherwise(json_text(meta)))
    )
    rows = rows.withColumn("text", text)
    text, said = F.col("text"), of.isin("text", "plain")
    kind = F.when(call, ev.TOOL_CALL).when(result, F.when(F.col("failed"), ev.TOOL_ERROR).otherwise(ev.TOOL_RESULT)).when(~said | compact, ev.COMPACTION).otherwise(F.when(role == "user", ev.USER).otherwise(ev.ASSISTANT))
    injected = F.when((of == "text") & (role == "user") & ~compact, is_injected_context(text)).otherwise(False)
    none = F.array().cast("array<string>")
    paths = F.when(call, F.coalesce(paths_of_input(F.col("input")), none)).otherwise(none)
    e = ev.event(kind, text, raw, F.when(of.isin("summary", "boundary"), F.lit(None)).otherwise(role), F.col("name"), paths, F.col("failed"), F.when(call, is_mutating_tool(F.col("name"))).otherwise(False), F.col("call"))
    # kept by a generator: a filter would be pushed below all the steps and repeat them
    heard = ~(said & (is_blank(text) | injected))
    out = rows.select("session_key", "session_id", "block_start", "line_no", "sub_no", "ts_raw", F.explode(ev.one(e, heard)).alias("e"))
    return out.select(F.lit(AGENT).alias("agent"), "*", F.col("ts_raw").try_cast("timestamp").alias("ts")).select("agent", "session_key", "session_id", "block_start", "line_no", "sub_no", "ts_raw", "ts", "e.*").select(*ev.COLUMNS)


def probe(lines: DataFrame) -> DataFrame:
    """session_key, session_id and cwd from each session's head."""
    v = F.col("v")
    cwd = F.coalesce(F.nullif(scalar_at(v, "$.cwd"), F.lit("")), scalar_at(v, "$.attachment.snapshot.workingDirectory"))
    return head_values(lines, *HEAD, {"session_id": scalar_at(v, "$.sessionId"), "cwd": cwd})
