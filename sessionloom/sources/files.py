"""Metadata and digests of files, without reading more than is asked for."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.shared import importable

#: Names that file systems have in Spark's paths and otherwise in Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def plain_path(uri: str) -> str:
    """A file's path as the file system has it, from the URI that Spark shows."""
    return re.sub("^file:/+", "/", unquote(uri))


def exact_path(uri: str) -> str:
    """A path that a reader takes as this one file, whatever characters are in it."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def file_listing(spark: SparkSession, paths: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """session_key, mtime and size of files; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select(F.col("_metadata.file_path").alias("session_key"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))


def digests(files: DataFrame) -> DataFrame:
    """session_key and SHA-256 of listed files of any size, each read in pieces by the task that holds its row; null if it can't be read."""
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("session_key").to_pylist():
                try:
                    with open_path(uri) as f:
                        found = sha256_stream(f)
                except OSError:
                    found = None
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([found], pa.string())], names=["session_key", "sha256"])

    return files.select("session_key").mapInArrow(run, "session_key string, sha256 string")


def sha256_stream(stream, chunk: int = 1 << 20) -> str:
    found = hashlib.sha256()
    while data := stream.read(chunk):
        found.update(data)
    return found.hexdigest()


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path of a local path, or of a URI of any kind that Arrow knows."""
    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), plain_path(uri)
    scheme, colon, rest = uri.partition(":")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest.replace(' ', '%20')}")


def open_path(uri: str) -> pa.NativeFile:
    """A file to be read from its start on."""
    files, path = located(uri)
    return files.open_input_stream(path, buffer_size=0)


def open_file(uri: str) -> pa.NativeFile:
    """A file to be read anywhere."""
    files, path = located(uri)
    return files.open_input_file(path)


def sha256_file(path: str) -> str | None:
    """The digest of one of the driver's own files, such as a report; null if it can't be read."""
    try:
        with open(path, "rb") as f:
            return sha256_stream(f)
    except OSError:
        return None


def write_atomic(path: str, text: str) -> None:
    """Writes beside the target, then renames, so that readers see all or nothing."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".sessionloom-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def archive_path(folder: str, name: str) -> str:
    """A name in `folder` that is not taken: with a number after it if need be."""
    stem, ext = os.path.splitext(name)
    path, n = os.path.join(folder, name), 1
    while os.path.exists(path):
        path, n = os.path.join(folder, f"{stem}-{n}{ext}"), n + 1
    return path


def memory_index(spark: SparkSession, places: list[tuple[str, str, str]], untracked: set[str] = frozenset()) -> DataFrame:
    """agent, label, path and detail of memory files and folders that exist; they are never opened.

    places: (agent, label, path). A folder's detail is its number of notes and the newest one's day.
    """
    rows = []
    for agent, label, path in places:
        if os.path.isdir(path):
            times = [e.stat().st_mtime for e in os.scandir(path) if e.is_file() and e.name.endswith(".md")]
            detail = f"{len(times)} file(s)" + (f", newest {datetime.fromtimestamp(max(times), timezone.utc):%Y-%m-%d}" if times else "")
        elif os.path.isfile(path):
            detail = f"{os.stat(path).st_size} B" + (", untracked" if os.path.basename(path) in untracked else "")
        else:
            continue
        rows.append((agent, label, path, detail))
    return spark.createDataFrame(rows, "agent string, label string, path string, detail string")
