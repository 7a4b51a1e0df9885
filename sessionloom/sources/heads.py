"""The first lines of listed files, read by the tasks that the listing is dealt to."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sessionloom.shared import importable
from sessionloom.sources.files import SCHEMES, open_path
from sessionloom.sources.jsonl import parsed

#: Bytes asked of a file at a time.
CHUNK = 64 << 10


def head_lines(stream: io.RawIOBase, max_lines: int, max_chars: int) -> Iterator[str]:
    """The lines of a file up to `max_lines`, or until `max_chars` characters are reached; no more is read than that and a chunk.

    Invalid UTF-8 is replaced. The line that reaches the limit is left out.
    """
    text = io.TextIOWrapper(io.BufferedReader(stream, CHUNK), encoding="utf-8", errors="replace")
    text._CHUNK_SIZE = CHUNK
    read = 0
    for _ in range(max_lines):
        line = text.readline(max_chars - read)
        read += len(line)
        if not line or read >= max_chars:
            return
        yield line.rstrip("\n")


def reachable(spark: SparkSession, root: str) -> bool:
    """Can tasks open the files below `root` by themselves?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return scheme in (*SCHEMES, "file", "hdfs", "s3", "gs")


def read_head_lines(files: DataFrame, max_lines: int, max_chars: int) -> DataFrame:
    """session_key, block_start, line_no and line of the heads of the files in `files`, a listing with session_key.

    A file is opened by the task that holds its row: nothing of it but its head
    is read, and no path goes through the driver. A file that can't be read, or
    has gone since it was listed, has no lines.
    """
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("session_key").to_pylist():
                try:
                    with open_path(uri) as f:
                        lines = list(head_lines(f, max_lines, max_chars))
                except OSError:
                    continue
                n = len(lines)
                columns = [pa.array([uri] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["session_key", "block_start", "line_no", "line"])

    return files.select("session_key").mapInArrow(run, "session_key string, block_start long, line_no long, line string")


def read_heads(files: DataFrame, max_lines: int, max_chars: int) -> DataFrame:
    """Parsed lines (as of `read_jsonl`) of the heads of listed files."""
    return parsed(read_head_lines(files, max_lines, max_chars))
