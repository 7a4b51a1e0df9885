"""Phrase collocations by hierarchical pair naming.

A frequent phrase of k words is named by the pair of the names of its first and
its last k-1 words. So phrases grow a word at a time: the texts become sequences
of word names; neighbours in a sequence of (k-1)-word names are a pair; pairs
are counted over the corpus, the frequent ones get a name, and put in place of
the words they make the sequence of the next level. Where a part is rare the
sequence is broken, since no phrase over it can be frequent.

The two names that a name stands for are its parents. Along them go the
frequencies of all first and last parts, for the cuts, and of the phrases that
hold a phrase, for the subsumption. No phrase is looked up by its words again.

How it runs. A task reads its documents once and writes, for each shard of at
most `SHARD_WORDS` words, the sequence of the shard's own word numbers and the
list of its words with counts, cut into bins by a hash. A bin adds up what all
shards say of its words, names the frequent ones and answers each shard with the
names of its own. Pairs are counted in the same way. Lists are packed arrays, so
that what moves is numbers and not rows. A shard's list is never larger than the
shard, so nothing is broadcast; a word that every document holds is one entry a
shard in its bin. All tables are written, so a lost executor costs a task.

Nulls and ties: a null text has no words, a null lang is `und`; repeated rows
and ids count as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import importable, release_memory, remove, shard_count, stored, temporary, text_bytes

#: Words of a shard.
SHARD_WORDS = 1 << 19
#: Bytes of text for which there is a bin.
BIN_BYTES = 2 << 20
#: Groups of a language that are cut to the reported length before they meet.
SALT = 64

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z lower-cased, and every break as a line feed.
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_BREAKS))

# what shards write: a sequence, or a bin's part of their list: `size` things, numbered from `first` on, with `left` (words, or rising names) and `right`
_LISTED = "shard long, sequence binary, bin int, lang string, first int, size int, `left` binary, `right` binary, number binary, total long"
# what bins write: the names of `size` of a shard's numbers (rising), or a frequent phrase
_NAMED = "shard long, size int, local binary, names binary, name long, `left` long, `right` long, lang string, word string, f long"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    """Tuples in the order of the schema as a table."""
    fields = [f.replace("`", "").split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for (_, kind), c in zip(fields, columns, strict=True)], names=[name for name, _ in fields])


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs: 1, 2, 4 or 8."""
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)}").tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // size if size else 1}").astype(np.int64)


def _packed_rising(x: np.ndarray) -> bytes:
    """Rising numbers by their steps."""
    return _packed(np.diff(x, prepend=0))


def _unpacked_rising(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, size))


def _cuts(bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bin with the places that have it."""
    order = np.argsort(bins, kind="stable")
    values, first = np.unique(bins[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, first[1:]))  # without values there is one empty part


class _Names(dict):
    """Words of a language in a shard; a new one gets the shard's next number."""

    def __init__(self, numbers: Iterator[int]):
        self._numbers = numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self._numbers)
        return n


class _Shard:
    """The sequence and the words of some texts."""

    def __init__(self, number: int):
        self.number, self.numbers = number, count(1)
        self.names: dict[str, _Names] = {}
        self.sequence: list[int] = []

    def rows(self, bins: int) -> pa.Table:
        sequence = np.array(self.sequence, dtype=np.int32)
        times = np.bincount(sequence)
        renumbered = np.zeros(len(times), dtype=np.int32)
        out, first = [], 1
        for lang, names in self.names.items():
            listed, local = list(names), np.fromiter(names.values(), dtype=np.int64, count=len(names))
            start = crc32(lang.encode("utf-8", "surrogatepass"))
            for bin_, at in _cuts(np.array([crc32(w, start) % bins for w in listed], dtype=np.int64)):
                number = times[local[at]]
                renumbered[local[at]] = np.arange(first, first + len(at))
                out.append((self.number, None, bin_, lang, first, len(at), b"\n".join([listed[i] for i in at.tolist()]), None, _packed(number), int(number.sum())))
                first += len(at)
        return _rows(_LISTED, [(self.number, renumbered[sequence].tobytes(), *[None] * 8), *out])


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text."""
    for piece in text.translate(_FOLDED).split(b"\n"):
        yield piece.split()


def _read(docs: DataFrame, bins: int, shard_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        shard = _Shard(next(numbers))
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if text is None:
                    continue
                lang = batch.column("lang")[i].as_py()
                for piece in words(text):
                    if not piece:
                        continue
                    if lang not in shard.names:
                        shard.names[lang] = _Names(shard.numbers)
                    shard.sequence += map(shard.names[lang].__getitem__, piece)
                    shard.sequence.append(0)
                    if len(shard.sequence) >= shard_words:
                        yield from shard.rows(bins).to_batches()
                        shard = _Shard(next(numbers))
        if shard.sequence:
            yield from shard.rows(bins).to_batches()
        del shard
        release_memory()

    return docs.mapInArrow(run, _LISTED)


def _answers(shard: np.ndarray, local: np.ndarray, name: np.ndarray) -> list[tuple]:
    """For each shard the names of its numbers."""
    order = np.lexsort((local, shard))
    shard, local, name = shard[order], local[order], name[order]
    return [(s, len(at), _packed_rising(local[at]), _packed(name[at]), *[None] * 6) for s, at in _cuts(shard)]


def _locals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The shard and the number of each thing that a bin's rows list."""
    size = np.array([r["size"] for r in rows], dtype=np.int64)
    begin = np.array([r["first"] for r in rows], dtype=np.int64) - (np.cumsum(size) - size)
    return np.repeat(np.array([r["shard"] for r in rows], dtype=np.int64), size), np.arange(int(size.sum())) + np.repeat(begin, size)


def _named_words(listed: DataFrame, bins: int, min_count: int) -> DataFrame:
    """The frequent words of each bin, and their names to the shards that hold them."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "lang", "first", "size", "left", "number"]).to_pylist()
        total: Counter[tuple[str, bytes]] = Counter()
        for r in rows:
            for word, n in zip(r["left"].split(b"\n"), _unpacked(r["number"], r["size"]).tolist(), strict=True):
                total[r["lang"], word] += n
        bin_ = table.column("bin")[0].as_py()
        frequent = {key: i * bins + bin_ + 1 for i, key in enumerate(k for k, n in total.items() if n >= min_count)}
        found = [(None, None, None, None, name, None, None, lang, word.decode(), total[lang, word]) for (lang, word), name in frequent.items()]
        name = np.array([frequent.get((r["lang"], word), 0) for r in rows for word in r["left"].split(b"\n")], dtype=np.int64)
        shard, local = _locals(rows)
        out = _rows(_NAMED, found + _answers(shard[name > 0], local[name > 0], name[name > 0]))
        release_memory()
        return out

    return listed.groupBy("bin").applyInArrow(run, _NAMED)


def _named_pairs(listed: DataFrame, bins: int, min_count: int) -> DataFrame:
    """The frequent pairs of each bin, and their names to the shards that hold them."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "first", "size", "left", "right", "number"]).to_pylist()
        left = np.concatenate([_unpacked_rising(r["left"], r["size"]) for r in rows])
        right, number = (np.concatenate([_unpacked(r[k], r["size"]) for r in rows]) for k in ("right", "number"))
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        f = np.add.reduceat(number[order], head)
        frequent = f >= min_count
        name = np.zeros(len(head), dtype=np.int64)
        name[frequent] = np.arange(int(frequent.sum())) * bins + table.column("bin")[0].as_py() + 1
        at = head[frequent]
        found = [(None, None, None, None, *x[:3], None, None, x[3]) for x in zip(name[frequent].tolist(), a[at].tolist(), b[at].tolist(), f[frequent].tolist(), strict=True)]
        each = np.repeat(name, np.diff(np.append(head, len(order))))
        kept = order[each > 0]
        shard, local = _locals(rows)
        out = _rows(_NAMED, found + _answers(shard[kept], local[kept], each[each > 0]))
        release_memory()
        return out

    return listed.groupBy("bin").applyInArrow(run, _NAMED)


def neighbours(sequence: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of pair numbers, and of each pair its two names and its count.

    sequence: numbers of a shard, 0 where it is broken; name: the name of each
    number, 0 if it has none.
    """
    named = name[sequence] != 0
    at = np.flatnonzero(named[:-1] & named[1:])
    keys, inverse, number = np.unique(sequence[at].astype(np.int64) << 32 | sequence[at + 1], return_inverse=True, return_counts=True)
    out = np.zeros(max(len(sequence) - 1, 0), dtype=np.int32)
    out[at] = inverse + 1
    return out, name[keys >> 32], name[keys & 0xFFFFFFFF], number


def _paired(sequences: DataFrame, names: DataFrame, bins: int) -> DataFrame:
    """Each shard's sequence of pairs, and its list of pairs, from the names of what is frequent."""

    def run(held: pa.Table, named: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and named.num_rows:
            shard = held.column("shard")[0].as_py()
            sequence = np.frombuffer(held.column("sequence")[0].as_py(), dtype=np.int32)
            name = np.zeros(int(sequence.max(initial=0)) + 1, dtype=np.int64)
            for r in named.select(["size", "local", "names"]).to_pylist():
                name[_unpacked_rising(r["local"], r["size"])] = _unpacked(r["names"], r["size"])
            pairs, left, right, number = neighbours(sequence, name)
            mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            bin_ = (mixed >> np.uint64(32)).astype(np.int64) % bins
            order = np.lexsort((left, bin_))
            renumbered = np.zeros(len(order) + 1, dtype=np.int32)
            renumbered[order + 1] = np.arange(1, len(order) + 1)
            out.append((shard, renumbered[pairs].tobytes(), *[None] * 8))
            left, right, number = left[order], right[order], number[order]
            for of, at in _cuts(bin_[order]):
                out.append((shard, None, of, None, int(at[0]) + 1, len(at), _packed_rising(left[at]), _packed(right[at]), _packed(number[at]), int(number[at].sum())))
        table = _rows(_LISTED, out)
        release_memory()
        return table

    return sequences.groupBy("shard").cogroup(names.groupBy("shard")).applyInArrow(run, _LISTED)


def _halves(df: DataFrame, kind: str, first: str, second: str) -> tuple[DataFrame, DataFrame, str]:
    """`df` as a table, read as two: the rows of one kind, and those of the other; and its place."""
    place = temporary(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(place)
    read = df.sparkSession.read.schema(df.schema)
    return read.parquet(place).where(first), read.parquet(place).where(second), place


def _levels(docs: DataFrame, min_count: int, max_words: int, shard_words: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to `max_words` words, and the number of words of each lang.

    Of a phrase: name, parents `left` and `right`, lang, phrase, last (its last
    word), f, and the frequencies of its first and last 1, 2, ... words.
    """
    spark = docs.sparkSession
    bins = shard_count(spark, text_bytes(docs, "text"), BIN_BYTES)
    sequences, listed, place = _halves(_read(docs, bins, shard_words), "shards", "sequence IS NOT NULL", "sequence IS NULL")
    total = stored(listed.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    found, named, _ = _halves(_named_words(listed, bins, min_count), "words", "name IS NOT NULL", "name IS NULL")
    nothing, none = F.lit(None).cast("long"), F.array().cast("array<long>")
    levels = [found.select("name", nothing.alias("left"), nothing.alias("right"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("first_f"), none.alias("last_f"))]
    for size in range(2, max_words + 1):
        before = place
        sequences, listed, place = _halves(_paired(sequences.select("shard", "sequence"), named.select("shard", "size", "local", "names"), bins), f"pairs{size}", "sequence IS NOT NULL", "sequence IS NULL")
        remove(spark, before)  # all that it held is in the new table
        found, named, _ = _halves(_named_pairs(listed, bins, min_count), f"names{size}", "name IS NOT NULL", "name IS NULL")
        counted = found.select("name", "left", "right", "f")
        a = b = levels[-1]
        first = a.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("start"), F.col("f").alias("left_f"), F.col("first_f").alias("left_firsts"))
        then = b.select(F.col("name").alias("right"), "last", F.col("f").alias("right_f"), F.col("last_f").alias("right_lasts"))
        phrases = counted.join(first, "left").join(then, "right")
        level = phrases.select(
            "name", "left", "right", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f",
            F.concat("left_firsts", F.array("left_f")).alias("first_f"), F.concat("right_lasts", F.array("right_f")).alias("last_f"),
        )
        levels.append(stored(level, f"phrases{size}"))
    return levels, total


def _scored(level: DataFrame, size: int) -> DataFrame:
    """The phrases with their lowest-scoring cut: score, l and r; products are decimals of 38 digits."""
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)") if isinstance(c, str) else c.cast(f"decimal({digits},0)")
    cuts = []
    for k in range(1, size):
        l, r = F.get("first_f", F.lit(k - 1)), F.get("last_f", F.lit(size - k - 1))  # noqa: E741
        product = F.lit(1_000_000).cast("decimal(7,0)") * (wide("f", 15) * wide("f", 15))
        cuts.append(F.struct(F.call_function("div", product, wide(l, 19) * wide(r, 19)).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return level.withColumn("cut", F.array_min(F.array(*cuts))).select("name", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, subsume_percent: int = 50, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at . , ; : ! ? and line ends,
    and those into words at blanks and tabs. A phrase of 2 to `max_words` words
    found a >= `min_count` times is a candidate. Cut after its first k words it
    scores floor(10**6 * a * a / (l * r)), l and r being the parts' frequencies;
    the lowest cut counts, the least k of equals. It goes if a longer candidate
    that holds its words has at least `subsume_percent` percent of its a: as no
    phrase is more frequent than its parts, those of one word more decide.
    Order: score and a falling, then the phrase by its bytes. Frequencies up to
    10**15 are exact. See the module for nulls.
    """
    importable(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    levels, total = _levels(docs, min_count, max_words, shard_words)
    found = []
    for size in range(2, max_words + 1):
        scored = _scored(levels[size - 1], size)
        if size < max_words:
            longer = levels[size]
            holds = longer.select(F.col("left").alias("name"), "f").unionByName(longer.select(F.col("right").alias("name"), "f")).groupBy("name").agg(F.max("f").alias("longer_f"))
            scored = scored.join(holds, "name", "left").where(F.expr(f"longer_f IS NULL OR 100 * longer_f < {subsume_percent} * a")).drop("longer_f")
        found.append(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
