"""Line-delimited JSON as a table of VARIANTs that keeps the order of lines and the bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds v (VARIANT, null if bad) and ok to rows with a column of lines, kept as raw; blank lines go.

    A line is good if it is one JSON object. The parser rejects NaN and
    repeated keys. What follows an object on its line makes it bad unless it
    ends in a brace itself.
    """
    text = F.trim(F.col(line), F.lit(" \t\r\n\f\v"))
    rows = lines.where(F.col(line).rlike(r"(?U)\S"))
    # a generator, so that later filters are not pushed below the parse, which would parse a line once for each of them
    rows = rows.select(*[c for c in rows.columns if c != line], F.col(line).alias("raw"), F.explode(F.array(F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(line)))).alias("v"))
    return rows.withColumn("ok", F.col("v").isNotNull())


def read_jsonl(spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """session_key (the file's path), block_start and line_no (which order a file's lines), mtime, size, v, ok.

    Large files are split; lines of a split are numbered in order, and splits
    are ordered by their start, so no sort is needed to know the order.
    Invalid UTF-8 is replaced.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("session_key"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
        F.make_valid_utf8("value").alias("line"),
    )
    return parsed(raw)


def block_log_files(root: str) -> str:
    """Sessions of the block dialect: one level of folders, no deeper."""
    return f"{root}/*/*.jsonl"


def patch_log_files(root: str) -> str:
    """Sessions of the patch dialect: each folder's chats, no deeper."""
    return f"{root}/*/chats/*.jsonl"


def places(agent: str, root: str) -> list[tuple[str, bool, str | None]]:
    """Where a dialect's files are: (path, with folders below, pattern), the first that holds any counts."""
    if agent == "rollout":
        return [(root, True, "rollout-*.jsonl"), (root, True, "*.jsonl")]
    return [({"block": block_log_files, "patch": patch_log_files}[agent](root), False, None)]


def read_rollout(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of the rollout dialect below `root`; any line-delimited file if none has the usual name."""
    from pyspark.errors import AnalysisException

    (usual, _, pattern), (_, _, other) = places("rollout", root)
    try:
        found = read_jsonl(spark, usual, True, pattern)
        if found.inputFiles():
            return found
    except AnalysisException:
        pass
    return read_jsonl(spark, root, True, other)


def _at(v: Column, path: str) -> Column:
    return v if path == "$" else F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """STRING, OBJECT, ARRAY, BIGINT and so on; null where nothing is."""
    return F.substring_index(F.substring_index(F.schema_of_variant(_at(v, path)), "<", 1), "(", 1)


def is_kind(v: Column, name: str, path: str = "$") -> Column:
    """Is the value of that kind? Null where nothing is."""
    schema = F.schema_of_variant(_at(v, path))
    return schema.startswith(name) if name in ("OBJECT", "ARRAY", "DECIMAL") else schema == name


def string_at(v: Column, path: str) -> Column:
    """The value if it is a string, else null."""
    return F.when(is_kind(v, "STRING", path), F.try_variant_get(v, path, "string"))


def scalar_at(v: Column, path: str) -> Column:
    """A string or number as text; '' for nothing, and for objects and lists."""
    schema = F.schema_of_variant(_at(v, path))
    return F.when(schema.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN|FLOAT)"), F.try_variant_get(v, path, "string")).otherwise("")


def object_at(v: Column, path: str) -> Column:
    """The value as a VARIANT if it is an object, else null."""
    return F.when(is_kind(v, "OBJECT", path), _at(v, path))


def list_at(v: Column, path: str) -> Column:
    """The elements if it is a list, else null."""
    return F.when(is_kind(v, "ARRAY", path), F.try_variant_get(v, path, "array<variant>"))


def json_text(v: Column) -> Column:
    return F.to_json(v)


def head_values(lines: DataFrame, max_lines: int, max_chars: int, values: dict[str, Column]) -> DataFrame:
    """The first non-null of each value in each session's first lines.

    Only a file's first split can hold its head, so other splits are dropped
    before anything is grouped.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("session_key").orderBy("line_no")
    head = lines.where(F.col("block_start") == 0).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_lines)
    head = head.withColumn("__read", F.sum(F.length("raw") + 1).over(order)).where(F.col("__read") < max_chars)
    rows = head.select("session_key", "__n", *[value.alias(name) for name, value in values.items()])
    firsts = [F.min_by(F.col(name), F.when(F.col(name).isNotNull() & (F.col(name) != ""), F.col("__n"))).alias(name) for name in values]
    return rows.groupBy("session_key").agg(*firsts)
