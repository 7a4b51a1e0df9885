"""The event table that all dialects normalise to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT = "user_message", "assistant_message"
TOOL_CALL, TOOL_RESULT, TOOL_ERROR = "tool_call", "tool_result", "tool_error"
COMPACTION, METADATA = "compaction", "session_metadata"
CONVERSATION = (USER, ASSISTANT, TOOL_CALL, TOOL_RESULT, TOOL_ERROR)

_FIELDS = "kind:string,role:string,text:string,tool_name:string,file_paths:array<string>,is_error:boolean,raw_type:string,mutating:boolean,call_id:string"
EVENT = f"struct<{_FIELDS}>"
#: Columns of the event table, in order.
COLUMNS = ["agent", "session_key", "session_id", "block_start", "line_no", "sub_no", "ts_raw", "ts", "kind", "role", "text", "tool_name", "file_paths", "is_error", "raw_type", "mutating", "call_id"]


def event(kind: Column | str, text: Column, raw_type: Column, role: Column | None = None, tool: Column | None = None, paths: Column | None = None, error: Column | None = None, mutating: Column | None = None, call: Column | None = None) -> Column:
    """One event as a struct; what is not given is empty."""
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (none if role is None else role).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
        (none if tool is None else tool).alias("tool_name"),
        (F.array().cast("array<string>") if paths is None else paths).alias("file_paths"),
        (F.lit(False) if error is None else error).alias("is_error"),
        raw_type.alias("raw_type"),
        (F.lit(False) if mutating is None else mutating).alias("mutating"),
        (none if call is None else F.nullif(call, F.lit(""))).alias("call_id"),
    )


def no_events() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def one(e: Column, when: Column | None = None) -> Column:
    """An array of the event, or of none if the condition fails."""
    return F.array(e) if when is None else F.when(when, F.array(e)).otherwise(no_events())


def table(rows: DataFrame, agent: str, events: Column) -> DataFrame:
    """Rows with session_key, session_id, block_start, line_no and ts_raw become one row for each of their `events`."""
    rows = rows.select("session_key", "session_id", "block_start", "line_no", "ts_raw", F.posexplode(events).alias("sub_no", "e"))
    return rows.select(F.lit(agent).alias("agent"), "session_key", "session_id", "block_start", "line_no", "sub_no", "ts_raw", F.col("ts_raw").try_cast("timestamp").alias("ts"), "e.*").select(*COLUMNS)


def described(values: Column, keys: tuple[str, ...], at, fallback: Column) -> Column:
    """`key: value` lines of the keys whose value is text; else the fallback."""
    lines = [F.when(at(k).rlike(r"(?U)\S"), F.concat(F.lit(f"{k}: "), at(k))) for k in keys]
    text = F.concat_ws("\n", *lines)
    return F.when(text != "", text).otherwise(fallback)
