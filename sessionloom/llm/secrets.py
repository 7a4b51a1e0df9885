"""Secret scans with an incremental blob ledger.

Each version of a document is addressed by the SHA-256 of its text, its blob.
The ledger is a folder of three tables:

* `paths` (doc_id, version, blob): every content a document has had, numbered
  by the document's own versions;
* `blobs` (blob, text): the text of each, by which versions that are long gone
  can be scanned under new rules (`rescan`);
* `findings` (blob, rule_version, spans): each blob scanned so far under a
  version of the rules, with what was found.

A run scans only pairs of blob and rule version that `findings` lacks (each once,
but for the first run over a large table, where copies in several tasks are
scanned in each), and `findings_of_paths` joins findings back to all paths. One run writes a
ledger at a time; a pair or a text that a broken run wrote counts once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import checkpointed, few_broadcast, join_to_one, keyed_text, slices

#: Unseen blobs up to which they are broadcast, so that texts are scanned where they lie.
BROADCAST_BLOBS = 100_000
#: Blobs that a task remembers as scanned before it starts anew.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the least length of a group, and a quick test that every match passes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()  # one of these is in the lower-cased text
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    # a maximal run under 32 characters fails anyway
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", needs=("private key-----",)),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{20,}", needs=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needs=("aiza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs=("eyj",)),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", needs=("k_live_", "k_test_")),
)
RULES = BASE + ADDED


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every match, by start, then by the order of the rules."""
    if not text:
        return []
    low = text.lower()
    out = []
    for number, (rule, pattern) in enumerate(rules):
        if rule.needs and not any(n in low for n in rule.needs):
            continue
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), number, m.end(), rule.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_FINDINGS = f"blob string, rule_version string, spans {_SPANS}"
_PATHS = "doc_id long, version int, blob string"
_SCANNED = f"blob string, text string, rule_version string, spans {_SPANS}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`; empty if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_findings(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rule_version, spans): one row for each pair, however often it was appended."""
    return _read(spark, f"{ledger}/findings", _FINDINGS).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def read_paths(spark: SparkSession, ledger: str) -> DataFrame:
    """(doc_id, version, blob): every content that each document has had."""
    return _read(spark, f"{ledger}/paths", _PATHS).groupBy("doc_id", "blob").agg(F.min("version").alias("version")).select("doc_id", "version", "blob")


def findings_of_paths(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, version, blob, spans) of every version of every document that was scanned under `rules`."""
    found = read_findings(spark, ledger).where(F.col("rule_version") == rule_version(rules)).select("blob", "spans")
    return join_to_one(checkpointed(read_paths(spark, ledger)), found, "blob").select("doc_id", "version", "blob", "spans")


def _scan(todo: DataFrame, rules: tuple[Rule, ...], version: str) -> DataFrame:
    """Rows (blob, text, stored) scanned, copies that a task meets once; the text is handed on if it is not stored yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        seen: set[str] = set()
        for batch in slices(batches):
            fresh = []
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                if blob not in seen:
                    seen.add(blob)
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            texts = batch.column("text").to_pylist()
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(text or "", compiled)] for text in texts]
            new = [None if stored else text for text, stored in zip(texts, batch.column("stored").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(new, pa.string()), pa.array([version] * len(texts), pa.string()), pa.array(found, kind)], names=["blob", "text", "rule_version", "spans"])

    return todo.select("blob", "text", "stored").mapInArrow(run, _SCANNED)


def _unseen(docs: DataFrame, rows: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (blob, text, stored) that hold all blobs that are not known; `stored`: is the text in the ledger?

    Up to `BROADCAST_BLOBS` such blobs go to the tasks that have the texts, and
    one row of each is picked by its id. With more, a ledger that is empty takes
    all rows as they lie, a copy once from each task that holds it; to one that
    is not, one row of each is dealt by blob and id, which deals copies evenly.
    """
    unseen = rows.groupBy("blob").agg(F.min("doc_id").alias("rep")).join(known.select("blob"), "blob", "left_anti")
    unseen = unseen.join(stored.select("blob", F.lit(True).alias("stored")), "blob", "left").select(F.col("blob").alias("rep_blob"), "rep", F.coalesce("stored", F.lit(False)).alias("stored"))
    unseen = checkpointed(unseen)
    few = unseen.count() <= BROADCAST_BLOBS
    if not few and known.isEmpty() and stored.isEmpty():
        return docs.select("blob", "text", F.lit(False).alias("stored"))
    unseen = F.broadcast(unseen) if few else unseen.hint("shuffle_hash")
    return docs.join(unseen, (docs["blob"] == unseen["rep_blob"]) & docs["doc_id"].eqNullSafe(unseen["rep"])).select("blob", "text", "stored")


def _append(found: DataFrame, ledger: str) -> None:
    """Scanned rows to the ledger: texts to its blobs, and what was found in them to its findings."""
    spark, place = found.sparkSession, f"{ledger}/blobs/run={uuid.uuid4().hex}"
    found.write.parquet(place)
    pairs = spark.read.schema(_SCANNED).parquet(place).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
    pairs.write.mode("append").parquet(f"{ledger}/findings")


def read_blobs(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, text): the stored text of every version of every document, though tasks of one run may each have stored a copy."""
    return _read(spark, f"{ledger}/blobs", _SCANNED).where("text IS NOT NULL").select("blob", "text")


def update_ledger(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Brings the ledger in folder `ledger` up to date; returns (doc_id, blob) of every row, and (blob, spans) of blobs with findings.

    Texts are read twice, to be addressed and to be scanned and stored; they are
    not shuffled unless a later run has over `BROADCAST_BLOBS` unseen blobs.
    """
    spark = df.sparkSession
    version = rule_version(rules)
    docs = keyed_text(df, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(text, '') AS text")
    docs = docs.withColumn("blob", blob_of(F.col("text")))
    rows = checkpointed(docs.select("doc_id", "blob"))

    pairs, paths = rows.distinct(), read_paths(spark, ledger)
    pairs = pairs.join(paths.select(F.col("doc_id").alias("of"), F.col("blob").alias("had")), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("blob") == F.col("had")), "left_anti")
    last = paths.groupBy(F.col("doc_id").alias("of")).agg(F.max("version").alias("last"))
    new = pairs.join(last, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "blob")
    checkpointed(new).write.mode("append").parquet(f"{ledger}/paths")

    known = _read(spark, f"{ledger}/findings", _FINDINGS).where(F.col("rule_version") == version)
    _append(_scan(_unseen(docs, rows, known, read_blobs(spark, ledger).select("blob").distinct()), rules, version), ledger)
    return rows, read_findings(spark, ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")


def rescan(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scans every stored blob, of old versions too, that was not scanned under `rules`; returns how many pairs the ledger gained."""
    version = rule_version(rules)
    known = _read(spark, f"{ledger}/findings", _FINDINGS).where(F.col("rule_version") == version)
    before = known.select("blob").distinct().count()
    todo = read_blobs(spark, ledger).join(known.select("blob"), "blob", "left_anti").withColumn("stored", F.lit(True))
    _append(_scan(todo, rules, version), ledger)
    return _read(spark, f"{ledger}/findings", _FINDINGS).where(F.col("rule_version") == version).select("blob").distinct().count() - before


def blob_of(text: F.Column) -> F.Column:
    """The address of a text; a null one counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_secrets(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Brings the ledger in folder `ledger` up to date, and returns doc_id, blob and spans of every row.

    Findings are joined back by blob; a blob that very many rows share stays
    where its rows are.

    A null text counts as an empty one; rows with a null id take part like
    others; repeated rows give repeated results; an empty table leaves the
    ledger as it was. A pair that two runs append counts once.
    """
    rows, findings = update_ledger(df, ledger, rules, id_col, text_col)
    return join_to_one(rows, findings, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def redact_secrets(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `df`, its texts with secrets cut out, and `__cut`: was there any?

    Texts meet the findings by blob, and stay where they are if the findings are
    few. Nulls and repeats as in `scan_secrets`; a null text stays null.
    """
    _, findings = update_ledger(df, ledger, rules, id_col, text_col)
    findings = few_broadcast(findings.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")))
    rows = df.withColumn("__blob", blob_of(F.col(text_col))).join(findings, "__blob", "left")
    cut = F.col("__spans").isNotNull()
    text = F.when(cut, redact(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns], cut.alias("__cut"))


def digest(scanned: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of the spans that `scan_secrets` returns, beside doc_id and the columns `more`."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    counts = [F.size(F.filter("spans", of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scanned.select("doc_id", *more, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """`text` with every span replaced by `mark`; spans that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)
