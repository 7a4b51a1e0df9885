"""Scalar functions over text, paths, times and sizes, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's White_Space.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space, of any kind in Unicode, at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def truncate_text(c: Column, limit: int | Column, label: str | Column = "text") -> Column:
    """At most `limit` characters, with a mark of the original length; 0 or less means all, null gives ''."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    label = F.lit(label) if isinstance(label, str) else label
    cut = F.concat(rstrip(F.substring(c, F.lit(1), limit)), F.lit("\n["), label, F.lit(" truncated: original length "), F.length(c).cast("string"), F.lit(" chars]"))
    return F.when(c.isNull(), "").when((limit <= 0) | (F.length(c) <= limit), c).otherwise(cut)


def collapse_blank_lines(c: Column, most: int = 2) -> Column:
    return F.regexp_replace(c, "\n{%d,}" % (most + 1), "\n" * most)


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def safe_component(c: Column, fallback: str = "unknown") -> Column:
    """One path component: runs of unsafe characters become `_`; what is empty or only dots is replaced."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(text.isin("", ".", ".."), fallback).otherwise(text)


def short_id(c: Column, length: int = 8) -> Column:
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(F.left(c, F.lit(length)))


def short_head(c: Column, length: int = 12) -> Column:
    """A commit hash cut to `length`; other text as it is."""
    return F.when(c.isNull() | (c == ""), "unknown").when(c.rlike(r"^[0-9a-f]{7,40}$"), F.left(c, F.lit(length))).otherwise(c)


def human_size(c: Column) -> Column:
    """Bytes in B, or with one decimal (a tie to even) in KiB to TiB."""
    out = F.when(c.isNull(), None).when(c < 1024, F.format_string("%d B", c.cast("long")))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(c < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(c / 1024.0**power, 1)))
    return out.otherwise(F.format_string("%.1f TiB", F.bround(c / 1024.0**4, 1)))


def iso_time(c: Column) -> Column:
    """A timestamp in the session's time zone, to the second; `unknown` for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("unknown"))


def ts_to_iso(v: Column) -> Column:
    """A log's time as ISO text: numbers are seconds or (above 1e11) milliseconds; other text stays as it is."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    text = strip(F.try_variant_get(v, "$", "string"))
    # without an offset the text is UTC
    parsed = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp")).otherwise(F.concat(text, F.lit("Z")).try_cast("timestamp"))
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), parsed)
    shown = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(kind == "STRING", F.when(text == "", None).otherwise(F.coalesce(shown, text))).when(
        kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ssxxx")
    )


def normalize_path(c: Column) -> Column:
    """Forward slashes, no slash at the end, drive letters' paths in lower case; '' for null."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\\", "/")
    text = F.when(text.rlike("^/+$"), "/").otherwise(F.regexp_replace(text, "/+$", ""))
    return F.when(text.rlike("^[A-Za-z]:(/|$)"), F.lower(text)).otherwise(text)


def path_is_within(candidate: Column, root: Column) -> Column:
    a, b = normalize_path(candidate), normalize_path(root)
    return (a != "") & (b != "") & ((a == b) | a.startswith(F.concat(b, F.lit("/"))))


def path_slug(c: Column) -> Column:
    """A path as a folder name: every character but ASCII letters and digits becomes `-`."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "-")


def name_slug(c: Column) -> Column:
    """A name in lower case, runs of other characters as one `-`; `project` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "project").otherwise(slug)


def head_tail(c: Column, budget: int, gap: str = "\n\n[... middle of the evidence left out ...]\n\n") -> Column:
    """Text over `budget` as its head (a third, 2000 characters at least, as far as there is room) and its tail.

    The gap counts too: the result is never longer than `budget`.
    """
    room = budget - len(gap)
    if room <= 0:
        return F.left(c, F.lit(max(budget, 0)))
    head = min(max(2000, budget // 3), room)
    tail = max(0, min(budget - head - 200, room - head))
    cut = F.concat(F.left(c, F.lit(head)), F.lit(gap), F.right(c, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(c) <= budget, c).otherwise(cut)
