"""Evidence files of all sessions at once: rendered by Spark, written by its tasks."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import is_blank, safe_component, short_id, strip
from sessionloom.plans.render import ALWAYS, NOTHING, SECTIONS
from sessionloom.shared import importable
from sessionloom.sources.files import located


def event_header(kind: Column, tool: Column, at: Column) -> Column:
    """An event's heading: its kind, tool and time."""
    label = F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.when(tool != "", F.concat(F.lit(" ("), tool, F.lit(")"))).otherwise(""))
    return F.when(at != "", F.concat(label, F.lit(" - "), at)).otherwise(label)


def evidence_texts(sessions: DataFrame, selected: DataFrame, stats: DataFrame, generated_at: str) -> DataFrame:
    """session_key, agent, session_id and text: the evidence file of each session, as `render_evidence` gives one.

    sessions: (agent, session_id, path); selected and stats as of
    `build_evidence`. Limits bound a session's evidence, so its texts, cut in
    the projection before, meet once, and nothing comes to the driver.
    """
    none = F.lit("")
    tool, at = F.coalesce("tool_name", none), F.coalesce("ts_raw", none)
    chunk = F.when(~is_blank(F.coalesce("text", none)), F.concat(F.lit("### "), event_header(F.col("kind"), tool, at), F.lit("\n\n"), strip(F.col("text")), F.lit("\n")))
    names = [name for _, group in SECTIONS for name in group]
    rows = selected.select("session_key", "bucket", "rank", chunk.alias("chunk"))
    held = rows.groupBy("session_key").agg(*(F.collect_list(F.when(F.col("bucket") == name, F.struct("rank", "chunk"))).alias(name) for name in names))

    def body(name: str) -> Column:
        chunks = F.filter(F.transform(F.array_sort(name), lambda x: x["chunk"]), lambda c: c.isNotNull())
        return F.concat(F.when(F.size(chunks) > 0, F.array_join(chunks, "\n")).otherwise(NOTHING), F.lit("\n"))

    parts = []
    for title, group in SECTIONS:
        shown = [F.lit(f"\n---\n\n## {title}\n\n")]
        for name in group:
            if len(group) > 1:
                shown.append(F.lit(f"### {'First ones' if name.startswith('first') else 'Last ones'}\n\n"))
            shown.append(body(name))
        there = F.lit(bool(ALWAYS & set(group)))
        for name in group:
            there = there | (F.size(name) > 0)
        parts.append(F.when(there, F.concat(*shown)).otherwise(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = lambda label, c: F.concat(F.lit(f"> {label}: "), c)
    head = F.concat_ws(
        "\n",
        F.lit("# Evidence of a session\n"),
        F.lit(f"> Generated at {generated_at}"),
        line("Source", F.col("agent")),
        line("Session", F.when(F.coalesce("session_id", none) != "", F.col("session_id")).otherwise("unknown")),
        line("Transcript", F.col("session_key")),
        line("Events parsed", number("total_events")),
        F.when(F.col("invalid_lines") > 0, line("Invalid lines ignored", number("invalid_lines"))),
        F.when(F.col("redactions") > 0, line("Possible secrets redacted", number("redactions"))),
    )
    text = F.concat(head, F.lit("\n\nQuoted from the transcript and cut where marked; the repository decides.\n"), *parts)
    known = sessions.select("agent", "session_id", F.col("path").alias("session_key")).join(stats, "session_key").join(held, "session_key", "left")
    empty = F.array().cast("array<struct<rank:int,chunk:string>>")
    known = known.withColumns({name: F.coalesce(name, empty) for name in names})
    return known.select("session_key", "agent", "session_id", F.regexp_replace(text, "\n{3,}", "\n\n").alias("text"))


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Writes each row's `text` to a file of its own below `folder`; returns (session_key, path, bytes), written.

    Files are named after agent, session and the hash of the session's path, so
    no two share one. A task writes beside the target and then renames, so a
    reader sees all of a file or the one before, and a task that is run again
    writes the same.
    """
    importable(texts.sparkSession)
    name = F.concat_ws("-", safe_component(F.col("agent")), safe_component(short_id(F.col("session_id"))), F.concat(F.left(F.sha2("session_key", 256), F.lit(16)), F.lit(".md")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = located(folder)
        files.create_dir(place)
        for batch in batches:
            paths, sizes = [], []
            for target, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, path = text.encode("utf-8", "replace"), posixpath.join(place, target)
                beside = f"{path}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(beside) as f:
                    f.write(data)
                files.move(beside, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("session_key"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["session_key", "path", "bytes"])

    return texts.select("session_key", name.alias("name"), "text").mapInArrow(run, "session_key string, path string, bytes long")
