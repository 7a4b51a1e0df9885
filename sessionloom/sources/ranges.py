"""Lines of files from a byte on, read in ranges by the tasks that they are dealt to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.shared import importable
from sessionloom.sources.files import open_file

#: Bytes of a range, and of what is asked of a file at a time.
RANGE, CHUNK = 64 << 20, 1 << 20
#: Lines of an Arrow batch.
LINES = 1000


def range_lines(stream, begin: int, end: int, size: int, first: bool) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, line) of the lines that begin in [begin, end) and end, with their line feed, by `size`.

    `first`: a line begins at `begin`; else the one that goes on there belongs to the range before.
    """
    at = begin if first else begin - 1
    stream.seek(at)
    held, skip = b"", not first
    while at < end or (held and at < size):
        data = stream.read(min(CHUNK, size - at - len(held)))
        if not data:
            return
        held += data
        *lines, rest = held.split(b"\n")
        for line in lines:
            following = at + len(line) + 1
            if at >= end:
                return
            if not skip:
                yield at, following, line
            skip, at = False, following
        held = rest


def read_ranges(files: DataFrame) -> DataFrame:
    """session_key, block_start (0), line_no (the byte at which it begins), ends and line, of listed files from `begin` to `size`.

    A line without its line feed is not finished, and is left for the next
    time. Every range is a row of its own, dealt by file and range, so that a
    large file is many tasks' work.
    """
    importable(files.sparkSession)
    last = F.greatest(F.col("size") - 1, F.col("begin"))
    ranges = files.where("size > begin").select("session_key", "size", F.col("begin").alias("of"), F.explode(F.sequence("begin", last, F.lit(RANGE).cast("long"))).alias("begin"))
    ranges = ranges.repartition("session_key", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, of, begin in zip(*(batch.column(c).to_pylist() for c in ("session_key", "size", "of", "begin")), strict=True):
                with open_file(uri) as f:
                    held = []
                    for row in range_lines(f, begin, min(begin + RANGE, size), size, begin == of):
                        held.append(row)
                        if len(held) == LINES:
                            yield _batch(uri, held)
                            held = []
                    yield _batch(uri, held)

    return ranges.mapInArrow(run, "session_key string, block_start long, line_no long, ends long, line string")


def _batch(uri: str, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([uri] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())], names=["session_key", "block_start", "line_no", "ends", "line"])
