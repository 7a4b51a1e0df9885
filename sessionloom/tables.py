"""Plain tables seen as event logs, and event logs written in each dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import events as ev

ROLE_KINDS = {"user": ev.USER, "assistant": ev.ASSISTANT, "system": ev.METADATA}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(rows: DataFrame, session: Column, block_start: Column, line_no: Column, e: Column) -> DataFrame:
    rows = rows.select(session.cast("string").alias("session_key"), block_start.cast("long").alias("block_start"), line_no.cast("long").alias("line_no"), e.alias("e"))
    return rows.select(F.lit("table").alias("agent"), "session_key", F.col("session_key").alias("session_id"), "block_start", "line_no", F.lit(0).alias("sub_no"), F.lit(None).cast("string").alias("ts_raw"), F.lit(None).cast("timestamp").alias("ts"), "e.*").select(*ev.COLUMNS)


def conversation_events(rows: DataFrame) -> DataFrame:
    """`conversations` as events: a conversation is a session, a turn a line."""
    kind = F.coalesce(F.create_map(*[x for k, v in ROLE_KINDS.items() for x in (F.lit(k), F.lit(v))])[F.col("role")], F.lit("other"))
    return _events(rows, F.col("conv_id"), F.lit(0), F.col("turn"), ev.event(kind, F.col("text"), F.col("role"), F.col("role")))


def log_events(rows: DataFrame) -> DataFrame:
    """`events` as events: a user is a session, ordered by time and id; errors are failures, purchases and signups changes."""
    t = F.col("event_type")
    change = t.isin("purchase", "signup")
    kind = F.when(t == "error", ev.TOOL_ERROR).when(change, ev.TOOL_CALL).otherwise(ev.TOOL_RESULT)
    path = F.concat(F.lit("item/"), F.get_json_object("props", "$.k"))
    e = ev.event(kind, F.col("props"), t, tool=t, paths=F.array(path), error=t == "error", mutating=change)
    return _events(rows, F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), e)


def _lines(rows: DataFrame, record: Column) -> DataFrame:
    return rows.select(F.col("conv_id").cast("string").alias("session_key"), F.lit(0).cast("long").alias("block_start"), F.col("turn").cast("long").alias("line_no"), F.to_json(record).alias("line"))


def block_lines(rows: DataFrame) -> DataFrame:
    """Conversations as lines of the block dialect, each text a block of a list."""
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(F.col("role"), F.array(block).alias("content"))
    return _lines(rows, F.struct(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), message.alias("message")))


def block_plain_lines(rows: DataFrame) -> DataFrame:
    """Conversations as lines of the block dialect: users' content is plain text, others' a thought and then a text."""
    thought = F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking"), F.lit(None).cast("string").alias("text"))
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("text"))
    plain = _lines(rows.where("role = 'user'"), F.struct(F.col("role").alias("type"), F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    listed = _lines(rows.where("role <> 'user'"), F.struct(F.col("role").alias("type"), F.struct(F.col("role"), F.array(thought, said).alias("content")).alias("message")))
    return plain.unionByName(listed)


def rollout_lines(rows: DataFrame) -> DataFrame:
    """Conversations as lines of the rollout dialect."""
    block = F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), F.col("text"))
    payload = F.struct(F.lit("message").alias("type"), F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), F.array(block).alias("content"))
    return _lines(rows, F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))


def patch_lines(rows: DataFrame) -> DataFrame:
    """Conversations as lines of the patch dialect, each turn a message of its own id."""
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise("user")
    return _lines(rows, F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("text").alias("content")))


def patch_operations(rows: DataFrame) -> DataFrame:
    """`events` as lines of the patch dialect: a signup rewinds to its key, other events write the message of theirs."""
    key = F.get_json_object("props", "$.k")
    record = F.when(F.col("event_type") == "signup", F.to_json(F.struct(key.alias("$rewindTo")))).otherwise(F.to_json(F.struct(key.alias("id"), F.lit("user").alias("type"), F.col("event_id").cast("string").alias("content"))))
    return rows.select(F.col("user_id").cast("string").alias("session_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("block_start"), F.col("event_id").alias("line_no"), record.alias("line"))


def _record(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select(F.col("user_id").cast("string").alias("session_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("block_start"), F.col("event_id").alias("line_no"), line.alias("line"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _even() -> Column:
    return F.col("event_id") % 2 == 0


def _props() -> Column:
    return F.col("props")


def _item() -> Column:
    return F.concat(F.lit("item/"), F.get_json_object("props", "$.k"))


def block_tool_lines(rows: DataFrame) -> DataFrame:
    """`events` in the block dialect: changes are calls, views and errors results, clicks compactions."""
    t = F.col("event_type")

    def message(role: str, block: Column) -> Column:
        return _json(type=F.lit(role), sessionId=F.col("user_id").cast("string"), message=F.struct(F.lit(role).alias("role"), F.array(block).alias("content")))

    given = F.struct(_item().alias("file_path"), _props().alias("description"))
    call = F.struct(F.lit("tool_use").alias("type"), F.when(t == "purchase", "Edit").otherwise("Grep").alias("name"), given.alias("input"))
    listed = F.struct(F.lit("tool_result").alias("type"), F.array(F.struct(F.lit("text").alias("type"), _props().alias("text")), F.struct(F.lit("image").alias("type"), F.lit("").alias("text"))).alias("content"), F.lit(False).alias("is_error"))
    failed = F.struct(F.lit("tool_result").alias("type"), _props().alias("content"), F.lit(True).alias("is_error"))
    boundary = _json(type=F.lit("system"), subtype=F.lit("compact_boundary"), compactMetadata=F.struct(F.lit("auto").alias("trigger"), F.col("event_id").alias("preTokens")))
    summary = _json(type=F.lit("summary"), summary=_props())
    line = F.when(t.isin("purchase", "signup"), message("assistant", call)).when(t == "view", message("user", listed)).when(t == "error", message("user", failed)).otherwise(F.when(_even(), boundary).otherwise(summary))
    return _record(rows, line)


def rollout_tool_lines(rows: DataFrame) -> DataFrame:
    """`events` in the rollout dialect: calls, changes of files, outputs, errors, compactions and metadata."""
    t = F.col("event_type")

    def response(**payload: Column) -> Column:
        return _json(type=F.lit("response_item"), payload=F.struct(*[v.alias(k) for k, v in payload.items()]))

    def item(**fields: Column) -> Column:
        inner = F.struct(F.lit("item_completed").alias("type"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("item"))
        return _json(type=F.lit("event_msg"), payload=inner)

    changes = F.create_map(_item(), F.struct(F.lit("update").alias("type")), F.lit("a.txt"), F.struct(F.lit("add").alias("type")))
    call = response(type=F.lit("function_call"), session_id=F.col("event_id").cast("string"), name=F.lit("exec"), arguments=F.when(_even(), F.concat(F.lit("cat >> "), _item())).otherwise(_props()))
    output = response(type=F.lit("function_call_output"), output=F.array(F.struct(F.lit("text").alias("type"), _props().alias("text"))))
    compacted = _json(type=F.lit("compacted"), payload=F.struct(F.lit("").alias("message"), F.array(F.struct(F.lit(1).alias("a")), F.struct(F.lit(2).alias("a"))).alias("replacement_history")))
    tool = item(type=F.lit("McpToolCall"), server=F.lit("srv"), tool=F.lit("find"), title=_props())
    meta = _json(type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("/w/"), _item()).alias("cwd"), F.lit("cli").alias("originator")))
    failed = response(type=F.lit("custom_tool_call_output"), output=F.concat(F.lit("Exit code: 1\n"), _props()))
    trouble = item(type=F.lit("Error"), message=_props())
    line = (
        F.when(t == "purchase", call)
        .when(t == "signup", item(type=F.lit("FileChange"), changes=changes))
        .when(t == "view", F.when(_even(), output).otherwise(compacted))
        .when(t == "click", F.when(_even(), tool).otherwise(meta))
        .otherwise(F.when(_even(), failed).otherwise(trouble))
    )
    return _record(rows, line)


def patch_tool_lines(rows: DataFrame) -> DataFrame:
    """`events` in the patch dialect: calls with results, answers, calls among parts, errors and ignored context."""
    t = F.col("event_type")

    def message(kind: str, **fields: Column) -> Column:
        return _json(id=F.concat(F.lit("e"), F.col("event_id").cast("string")), type=F.lit(kind), **fields)

    used = F.array(F.struct(F.lit("write_file").alias("name"), F.struct(_item().alias("file_path")).alias("args"), _props().alias("result")))
    answer = F.array(F.struct(F.struct(F.lit("look").alias("name"), F.struct(_props().alias("output")).alias("response")).alias("functionResponse")))
    calls = F.array(F.to_json(F.struct(F.lit("done").alias("text"))), F.to_json(F.struct(F.struct(F.lit("run_shell_command").alias("name"), F.struct(F.concat(F.lit("cat >> "), _item()).alias("command")).alias("args")).alias("functionCall"))))
    head = message("gemini")
    parts = F.concat(F.expr("left(%s, length(%s) - 1)" % (("__head",) * 2)), F.lit(',"content":['), F.array_join(calls, ","), F.lit("]}"))
    rows = rows.withColumn("__head", head)
    line = (
        F.when(t == "purchase", message("gemini", content=F.lit(""), toolCalls=used))
        .when(t == "view", message("user", content=answer))
        .when(t == "click", parts)
        .when(t == "error", message("error", content=_props()))
        .otherwise(message("user", content=F.lit("<session_context>none typed this</session_context>")))
    )
    return _record(rows, line)


def patch_set_lines(rows: DataFrame) -> DataFrame:
    """`events` in the patch dialect: signups replace the list, clicks are headers with messages, others write one."""
    k = F.get_json_object("props", "$.k")
    message = lambda end: F.struct(F.concat(k, F.lit(end)).alias("id"))
    replaced = F.to_json(F.struct(F.struct(F.array(message(""), message("b"), message("")).alias("messages")).alias("$set")))
    header = _json(sessionId=F.col("user_id").cast("string"), projectHash=F.lit("h"), messages=F.array(message("b"), message("c")))
    t = F.col("event_type")
    return _record(rows, F.when(t == "signup", replaced).when(t == "click", header).otherwise(_json(id=k)))


def patch_note_lines(rows: DataFrame) -> DataFrame:
    """`events` in the patch dialect: purchases save a note, errors rewind, clicks set nothing of either, others write a message."""
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    saved = F.to_json(F.struct(F.struct(F.concat(F.lit("note "), k).alias("memoryScratchpad")).alias("$set")))
    other = F.to_json(F.struct(F.struct(k.alias("title")).alias("$set")))
    rewind = F.to_json(F.struct(k.alias("$rewindTo")))
    return _record(rows, F.when(t == "purchase", saved).when(t == "error", rewind).when(t == "click", other).otherwise(_json(id=k)))
