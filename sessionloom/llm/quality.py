"""Quality rules: statistics of texts and a decision list learned from labels.

Sequential covering: a rule, a conjunction of thresholds on statistics, is
grown on one part of the labelled sample by information gain, pruned on the
other part, kept if it is precise there, and what it covers is taken away. The
rules in order become one Spark CASE expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import importable, keyed_text, slices

#: Labelled rows that the learner sees at most, chosen by a hash of their id.
MAX_LABELLED = 6_000
#: A rule's least precision on rows that it was not grown on, and least coverage.
MIN_PRECISION = 0.97
MIN_COVER = 8

SPAN = 8
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATIOS = ["symbol_ratio", "mean_word", "upper_ratio", "bang_ratio", "bar_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "block_distinct", "stop_ratio"]
#: Statistics that a rule may test.
FEATURES = _RATIOS

_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside a window of `span` words that occurs at least twice, overlaps counted."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    # classes of windows of 1, 2, 4 ... words, exact at each step
    width, classes = 1, ids
    while width < span:
        step = min(width, span - width)
        pair = classes[: len(words) - width - step + 1] * np.int64(len(words) + 1) + classes[step:]
        order = np.argsort(pair, kind="stable")
        s = pair[order]
        new = np.append(0, s[1:] != s[:-1])
        rank = np.cumsum(new)
        if rank[-1] == len(rank) - 1:
            return 0  # all differ, so longer ones do
        classes = np.empty_like(pair)
        classes[order] = rank
        width += step
    again = np.bincount(classes)[classes] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + span, -1)
    return int((np.cumsum(cover) > 0).sum())


def block_distinct(words: list[bytes], size: int = 50) -> float:
    """Mean share of distinct words in blocks of `size` words, which a text's length does not shift.

    Words left over at the end are in a last block of `size` words, which
    overlaps the one before.
    """
    last = max(len(words) - size, 0)
    blocks = [words[i : i + size] for i in (*range(0, last, size), last)]
    return sum(len(set(b)) / max(len(b), 1) for b in blocks) / len(blocks)


def statistics(text: str | None) -> tuple:
    """The counts and ratios of one text; a null text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digit = len(raw) - len(raw.translate(None, b"0123456789"))
    c, w = max(chars, 1), max(n, 1)
    short = sum(1 for x in words if len(x) < 4)
    ratios = (symbols / c, chars / w, upper / c, raw.count(b"!") / c, raw.count(b"|") / c, digit / c, dup / max(lines, 1), repeat / w, block_distinct(words), short / w)
    return (n, chars, symbols, dup, repeat, *ratios)


def with_statistics(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """All rows and columns of `df`, and the statistics of every whole text, row by row; nothing is shuffled."""
    importable(df.sparkSession)
    names = [prefix + c for c in (*_COUNTS, *_RATIOS)]
    kinds = [pa.int64()] * len(_COUNTS) + [pa.float64()] * len(_RATIOS)
    added = [T.StructField(n, T.LongType() if k == pa.int64() else T.DoubleType()) for n, k in zip(names, kinds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t) for t in batch.column(text_col).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text, row by row; nothing is shuffled.

    A null or empty text has zeros; repeated rows give repeated results; an
    empty table gives an empty result.
    """
    return with_statistics(keyed_text(df, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), "text").drop("text")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it "at least", threshold) that rejects a text."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    cover: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, up, t in self.tests:
            out &= (x[name] >= t) if up else (x[name] <= t)
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, up, t in self.tests:
            value = F.col(prefix + name)
            out = out & ((value >= F.lit(t)) if up else (value <= F.lit(t)))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, features: list[str], most: int = 4) -> list[tuple[str, bool, float]]:
    """Adds the threshold of most information gain until only bad rows are covered."""
    tests: list[tuple[str, bool, float]] = []
    covered = np.ones(len(bad), dtype=bool)
    while len(tests) < most:
        p0, n0 = (bad & covered).sum(), (~bad & covered).sum()
        if not p0 or not n0:
            break
        best = (0.0, None)
        for name in features:
            v, b = x[name][covered], bad[covered]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            p, n = np.cumsum(b)[cut - 1], np.cumsum(~b)[cut - 1]
            for up, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best[0] + 1e-12:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (name, up, float((v[cut[i] - 1] + v[cut[i]]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        covered &= Rule((best[1],), 0, 0).holds(x)
    return tests


def _worth(tests: list, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, float, int]:
    hit = Rule(tuple(tests), 0, 0).holds(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / max(p + n, 1), p / max(p + n, 1), p + n


def learn(x: dict[str, np.ndarray], bad: np.ndarray, features: list[str] | None = None) -> list[Rule]:
    """The ordered rules; no rows or no bad rows give no rules."""
    features = features or FEATURES
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    held_out = np.arange(len(bad)) % 3 == 2
    while (bad & left).sum() >= MIN_COVER:
        part = [{k: v[left & m] for k, v in x.items()} for m in (~held_out, held_out)]
        tests = _grow(part[0], bad[left & ~held_out], features)
        if not tests:
            break
        check = bad[left & held_out]
        while len(tests) > 1 and _worth(tests[:-1], part[1], check)[0] >= _worth(tests, part[1], check)[0]:
            tests = tests[:-1]
        _, precision, cover = _worth(tests, part[1], check)
        if precision < MIN_PRECISION or cover < MIN_COVER // 3:
            break
        rules.append(Rule(tuple(tests), precision, cover))
        left &= ~rules[-1].holds(x)
    return rules


def base_failed(prefix: str = "") -> Column:
    """Under 20 words, or over 30 of 100 words in repeated 8-word windows."""
    return (F.col(f"{prefix}n_words") < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * F.col(f"{prefix}n_words"))


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as ordered conditions: the number of the first rule that holds, 0 if none does."""
    out = F
    for i, rule in enumerate(rules, 1):
        out = out.when(rule.column(prefix), F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns from at most `max_labelled` labelled rows, those of least hashed id.

    A row is bad if the mean of its labels is under 1/2; null labels and null
    ids are left out. The sample's ids, a number of rows that the parameter
    bounds, are broadcast. Rows that share a sampled id all count, up to twice
    the bound in all.
    """
    sample = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("label") < 0.5).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = text_statistics(keyed_text(df, id_col, text_col).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_labelled).toPandas()
    return learn({c: rows[c].to_numpy(dtype=float) for c in FEATURES}, rows["bad"].to_numpy(dtype=bool))


def quality_rules(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, the number of the rule that fired, and kept.

    base_failed: under 20 words, or over 30 of 100 words in repeated 8-word
    windows. A text is kept if neither the base nor a rule rejects it. Nulls
    and empty tables as in `text_statistics`.
    """
    out = text_statistics(df, id_col, text_col)
    out = out.withColumn("base_failed", base_failed())
    out = out.withColumn("rule", verdict(rules))
    return out.withColumn("kept", F.expr("NOT base_failed AND rule = 0"))


def with_verdict(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """All rows and columns of `df`, and `__kept` as in `quality_rules`, by the same conditions; texts are not shuffled."""
    out = with_statistics(df, text_col, "__")
    return out.select(*df.columns, (~base_failed("__") & (verdict(rules, "__") == 0)).alias("__kept"))
