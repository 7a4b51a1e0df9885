"""Bounded evidence of each session: first and last events, errors, changes, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import Limits
from sessionloom.functions.classify import base_name, is_credential_name, is_credential_path
from sessionloom.functions.redact import scrub
from sessionloom.functions.text import truncate_text
from sessionloom.operators import events as ev
from sessionloom.shared import few_broadcast

# What stands in for withheld text.
WITHHELD_FILE = "[REDACTED: content of a file that looks like a credential store]"
WITHHELD_CALL = "[REDACTED: tool call referencing a possible credential file]"

WITHHELD_RESULT = "[REDACTED: result of a tool call that was withheld]"

ORDER = ["block_start", "line_no", "sub_no"]


def trim(events: DataFrame, limits: Limits = Limits(), strict: bool = False) -> DataFrame:
    """Events with their text redacted or withheld, then truncated, and `redactions`, the secrets replaced.

    It is a projection, so texts are short before anything is shuffled. What a
    session describes about itself is left as it is. `strict`: the result of a
    call that is withheld is withheld too; the calls' ids are found first, and
    go to the tasks that have the results.
    """
    if strict:
        events = events.join(few_broadcast(withheld_calls(events)), ["session_key", "call_id"], "left")
    hidden = F.coalesce(F.col("__hidden"), F.lit(False)) if strict else F.lit(False)
    tool = F.col("kind").isin(ev.TOOL_CALL, ev.TOOL_RESULT, ev.TOOL_ERROR)
    by_path = (F.size("file_paths") > 0) & F.exists("file_paths", lambda p: is_credential_path(p))
    by_text = is_credential_name(F.col("__base"))
    zero = F.lit(0).cast("long")
    kept = lambda text: F.struct(F.lit(text).alias("text"), zero.alias("hits"))
    done = F.when(F.col("kind") == ev.METADATA, F.struct(F.col("text").alias("text"), zero.alias("hits")))
    done = done.when(by_path, kept(WITHHELD_FILE)).when(hidden & (F.col("kind") != ev.TOOL_CALL), kept(WITHHELD_RESULT)).when(by_text, kept(WITHHELD_CALL)).otherwise(scrub(F.col("text")))
    limit = F.when(tool, limits.max_tool_text_chars).otherwise(limits.max_text_chars)
    label = F.when(F.col("kind").isin(ev.TOOL_RESULT, ev.TOOL_ERROR), "tool result").otherwise("text")
    events = events.withColumn("__base", F.when(F.col("kind") == ev.TOOL_CALL, base_name(F.left("text", F.lit(400)))))
    rows = events.withColumn("__done", done)
    text = F.when(F.col("kind") == ev.METADATA, F.col("__done.text")).otherwise(truncate_text(F.col("__done.text"), limit, label))
    return rows.withColumn("text", text).withColumn("redactions", F.col("__done.hits")).drop("__done", "__base", "__hidden")


def withheld_calls(events: DataFrame) -> DataFrame:
    """(session_key, call_id, __hidden) of calls whose text `trim` withholds."""
    calls = events.where((F.col("kind") == ev.TOOL_CALL) & F.col("call_id").isNotNull())
    secret = F.exists("file_paths", lambda p: is_credential_path(p)) | is_credential_name(base_name(F.left("text", F.lit(400))))
    return calls.where(secret).select("session_key", "call_id", F.lit(True).alias("__hidden")).distinct()


def buckets_of(limits: Limits) -> list[tuple[str, Column, bool, int]]:
    """(bucket, which events, whether the last ones are kept, how many)."""
    kind, said = F.col("kind"), F.col("kind").isin(*ev.CONVERSATION)
    return [
        ("first_events", said, False, limits.first_events),
        ("last_events", said, True, limits.last_events),
        ("errors", F.col("is_error") & (kind != ev.COMPACTION), True, limits.max_errors),
        ("mutating_tools", F.col("mutating") & (kind == ev.TOOL_CALL), True, limits.max_tool_events),
        ("compactions", kind == ev.COMPACTION, True, limits.max_compactions),
        ("first_user_messages", kind == ev.USER, False, limits.user_messages),
        ("last_user_messages", kind == ev.USER, True, limits.user_messages),
    ]


def select_buckets(events: DataFrame, limits: Limits = Limits(), buckets: list | None = None, order: list[str] | None = None) -> DataFrame:
    """session_key, bucket, rank (from 1, in the session's order) and the events' columns.

    One pass: an event goes to all its buckets at once, and one ranking by
    (session, bucket) serves first and last alike, as the order is negated for
    the last ones. The ranks over the largest limit are cut in each map task,
    so what is shuffled of a session is bounded.
    """
    order = order or ORDER
    chosen = [b for b in (buckets or buckets_of(limits)) if b[3] > 0]
    if not chosen:
        return events.withColumn("bucket", F.lit("")).withColumn("rank", F.lit(0)).limit(0)
    tags = F.array(*[F.when(when, F.struct(F.lit(name).alias("bucket"), F.lit(-1 if last else 1).alias("way"), F.lit(n).alias("most"))) for name, when, last, n in chosen])
    rows = events.withColumn("__tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    toward = [F.col("__tag.way") * F.col(c) for c in order]
    w = Window.partitionBy("session_key", "__tag.bucket").orderBy(*toward)
    most = max(b[3] for b in chosen)
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).where(F.col("__n") <= F.col("__tag.most"))
    again = Window.partitionBy("session_key", "__tag.bucket").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(again)).withColumn("bucket", F.col("__tag.bucket")).drop("__tag", "__n")


def merge_buckets(selected: DataFrame, limits: Limits = Limits(), order: list[str] | None = None) -> DataFrame:
    """Rows of several `select_buckets` of the same sessions, of disjoint events, as one selection of all their events."""
    order = order or ORDER
    bounds = F.create_map(*[F.lit(x) for name, _, last, n in buckets_of(limits) for x in (name, (-1 if last else 1) * n)])
    rows = selected.withColumn("__most", bounds[F.col("bucket")])
    w = Window.partitionBy("session_key", "bucket").orderBy(*[F.signum("__most") * F.col(c) for c in order])
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.abs("__most"))
    again = Window.partitionBy("session_key", "bucket").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(again)).drop("__most", "__n")


def distinct_selected(selected: DataFrame, key: list[str] | None = None) -> DataFrame:
    """session_key and events_selected: events in any bucket, each counted once."""
    return selected.groupBy("session_key").agg(F.countDistinct(*(key or ORDER)).alias("events_selected"))


def counts_by(events: DataFrame, value: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """session_key, value, n and first (the first place): by n descending, then by first, `most` for a session."""
    place = F.struct(*(order or ORDER))
    out = events.groupBy("session_key", value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    if most is not None:
        w = Window.partitionBy("session_key").orderBy(F.desc("n"), "first")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return out


def kind_counts(events: DataFrame) -> DataFrame:
    return counts_by(events, "kind")


def tool_counts(events: DataFrame, most: int | None = 15) -> DataFrame:
    """Uses of each tool; the patch dialect counts results too."""
    return counts_by(events.where((F.col("tool_name") != "") & (F.col("kind") != ev.METADATA)), "tool_name", most)


def touched_files(events: DataFrame) -> DataFrame:
    """session_key, path, n, first, and n_mutating (uses by changing calls alone)."""
    rows = events.where(F.col("kind") != ev.METADATA).select("session_key", *ORDER, "mutating", F.posexplode("file_paths").alias("pos", "path"))
    place = F.struct(*ORDER, "pos")
    return rows.groupBy("session_key", "path").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.count_if("mutating").alias("n_mutating"))


def session_counts(trimmed: DataFrame) -> DataFrame:
    """Events of each session by kind and tool: n, first, redactions, and the first folder that metadata names; these can be added up."""
    cwd = F.trim(F.regexp_extract("text", r"(?m)^cwd:\s*(.+)$", 1))
    found = F.when((F.col("kind") == ev.METADATA) & (cwd != ""), cwd)
    at = F.struct(*ORDER)
    return trimmed.groupBy("session_key", "kind", "tool_name").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.sum("redactions").alias("redactions"), F.min(F.when(found.isNotNull(), F.struct(at.alias("at"), found.alias("cwd")))).alias("cwd")
    )


def added_counts(counts: DataFrame) -> DataFrame:
    """Several `session_counts` in one table, added up."""
    return counts.groupBy("session_key", "kind", "tool_name").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("redactions").alias("redactions"), F.min("cwd").alias("cwd"))


def bad_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_key").agg(F.count_if(~F.col("ok")).alias("invalid_lines"))


def session_stats(trimmed: DataFrame, lines: DataFrame | None = None, most_tools: int = 15) -> DataFrame:
    """One row for each session: total_events, redactions, session_cwd, event_kinds, top_tools, invalid_lines.

    trimmed: events from `trim`; lines: parsed lines, of which bad ones are counted.
    Events are counted by session, kind and tool in one aggregation, partly in
    the tasks that have them; all else comes from these counts.
    """
    return stats_of(session_counts(trimmed), None if lines is None else bad_lines(lines), most_tools)


def stats_of(counts: DataFrame, bad: DataFrame | None = None, most_tools: int = 15) -> DataFrame:
    """`session_stats` from `session_counts` and `bad_lines`."""
    tool = (F.col("tool_name") != "") & (F.col("kind") != ev.METADATA)
    facets = F.array(F.struct(F.lit(False).alias("tool"), F.col("kind").alias("value")), F.when(tool, F.struct(F.lit(True).alias("tool"), F.col("tool_name").alias("value"))))
    # the counts of a session meet once; the steps below need no further exchange
    rows = counts.repartition("session_key").withColumn("facet", F.explode(F.array_compact(facets)))
    kind = ~F.col("facet.tool")
    each = rows.groupBy("session_key", "facet").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(kind, F.col("redactions"))).alias("redactions"), F.min(F.when(kind, F.col("cwd"))).alias("cwd")
    )
    place = F.row_number().over(Window.partitionBy("session_key", "facet.tool").orderBy(F.desc("n"), "first"))
    each = each.withColumn("place", place)

    def listed(name: str, of: Column) -> Column:
        items = F.collect_list(F.when(of, F.struct("place", F.struct(F.col("facet.value").alias(name), "n").alias("e"))))
        return F.transform(F.array_sort(items), lambda x: x["e"])

    out = each.groupBy("session_key").agg(
        F.sum(F.when(kind, F.col("n"))).alias("total_events"),
        F.sum("redactions").alias("redactions"),
        F.min("cwd")["cwd"].alias("session_cwd"),
        listed("kind", kind).alias("event_kinds"),
        listed("tool", ~kind & (F.col("place") <= most_tools)).alias("top_tools"),
    )
    # as for a session without tools before: none is null
    out = out.withColumn("top_tools", F.when(F.size("top_tools") > 0, F.col("top_tools")))
    if bad is None:
        return out.withColumn("invalid_lines", F.lit(0).cast("long"))
    return out.join(bad, "session_key", "full").fillna(0, ["total_events", "redactions", "invalid_lines"])
