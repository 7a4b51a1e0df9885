"""Packing of tokenised documents into sequences of a fixed length, certified by lower bounds.

1. Every whole text is encoded once (`pieces`); a document longer than a
   sequence is cut, its first piece taking what is over. Full pieces are
   sequences of their own. From here on only numbers move.
2. Pieces are dealt to partitions. A partition packs best-fit decreasing, on the
   counts of its lengths: equal lengths are placed together, so that the work
   depends on the lengths there are and not on the pieces. It does so twice,
   by document (each goes where it fits best) and by sequence (each takes what
   fills it best), and keeps what needs fewer sequences.
3. Dual-feasible functions bound from below how many sequences are needed. The
   one that binds most over all pieces certifies each partition: where it fills
   the partition's sequences, no packing of anything saves there, and they stay.
   Partitions with a gap exchange: their pieces are dealt anew, by another hash,
   to fewer and larger partitions of up to `PIECES` pieces, and packed again.
   That ends when the sequences meet the bound, without gaps, or when it saves
   no sequence.

A partition has `PIECES` pieces at most on average, of some 60 bytes, so its
memory is bounded; the driver gets counts. Each round is a written table, so a
lost executor costs a task and never changes what was certified.

Nulls and ties: a null text is an empty document, of the end token alone; null
and repeated ids, and repeated rows, are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.bpe import SUPPORTED, byte_characters
from sessionloom.llm.common import importable, keyed_text, release_memory, shuffle_partitions, slices, stored

#: Pieces of a partition, from which their number follows.
PIECES = 1 << 18
#: Times that partitions with gaps exchange, at most, and by how much fewer they become each time.
ROUNDS = 5
FEWER = 16

_PIECE = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", part int, bin long, offset long, gap long, bins long"
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64()}


# --- tokens


class Encoder:
    """Ids of a text as the tokenizer of `spec` (a tokenizers JSON file's text) gives them.

    Byte-level BPE without a normaliser is a matter of ranks and a split
    pattern, which another library does several times faster; tests hold its
    ids against the tokenizer's own, for every character. Texts that hold an
    added token's string go to the tokenizer itself.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self._added = [t["content"] for t in parsed["added_tokens"]]
        ranks = {bytes(to_byte[c] for c in token): rank for token, rank in parsed["model"]["vocab"].items() if token not in self._added}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_str(spec)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self._added):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self._fast.encode_ordinary(text), dtype=np.uint32)


@lru_cache(maxsize=2)
def _encoder(spec: str, pattern: str) -> Encoder:
    return Encoder(spec, pattern)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(df: DataFrame, tokenizer_path: str, pattern: str = SUPPORTED, end_token: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (unique), doc_id, piece, start, length and ids_crc32 of each document's pieces; texts are not shuffled."""
    importable(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        key = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encoder.encode(text or ""), np.uint32(end_token)).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((key, doc, number, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    key += 1
            yield _record(_PIECE, zip(*rows, strict=True) if rows else [[]] * 6)

    return keyed_text(df, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, _PIECE)


def _record(schema: str, columns) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=_KINDS[kind]) for (_, kind), c in zip(fields, columns, strict=True)], names=[n for n, _ in fields])


# --- bounds


@lru_cache(maxsize=4)
def _functions(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual-feasible functions of the lengths 0 to `capacity`, as integers: a row each, and what a full sequence counts.

    First those that leave out lengths under k and count those over
    capacity - k as full ones (k = 0 leaves all as they are); then those that
    round to multiples of 1/k.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    rows, full = [], []
    for k in range(capacity // 2 + 1):
        rows.append(np.where(size > capacity - k, capacity, np.where(size >= k, size, 0)))
        full.append(capacity)
    for k in range(1, min(100, capacity) + 1):
        times = (k + 1) * size
        rows.append(np.where(times % capacity == 0, k * size, times // capacity * capacity))
        full.append(capacity * k)
    return np.array(rows), np.array(full, dtype=np.int64)


def binding(counts: np.ndarray, capacity: int) -> tuple[int, int, np.ndarray]:
    """(sum, full, function) of the function that asks for most: sum / full sequences are needed; counts: how many pieces have each length from 0 on."""
    rows, full = _functions(capacity)
    # exact whatever the counts: a few hundred functions of as many lengths as there are
    there = np.flatnonzero(counts)
    many = counts[there].astype(object)
    sums = [int((row[there].astype(object) * many).sum()) for row in rows] if counts.sum() >= 2**42 // capacity else (rows @ counts).tolist()
    best = max(range(len(sums)), key=lambda i: Fraction(sums[i], int(full[i])))
    return sums[best], int(full[best]), rows[best]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """So many sequences any packing of these lengths needs."""
    total, full, _ = binding(counts, capacity)
    return -(-total // full)


# --- best fit on counts; a pattern is (number of sequences, ((length, times), ...))

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def by_document(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each length, from the longest, goes to the fullest sequences that can take it.

    Sequences with equal room are alike; they are filled together. `rooms` has a
    bit for each room that some sequence has left.
    """
    held: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fits = rooms >> size
            if fits:
                room = (fits & -fits).bit_length() - 1 + size
                number, inside = held[room].pop()
            else:
                room, number, inside = capacity, left, ()
            times = min(room // size, left)
            taken = min(number, left // times)
            if fits:
                if taken < number:
                    held[room].append((number - taken, inside))
                if not held[room]:
                    rooms &= ~(1 << room)
            left -= taken * times
            room -= size * times
            held[room].append((taken, (*inside, (size, times))))
            rooms |= 1 << room
    return [p for group in held for p in group]


def by_sequence(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing by sequence: the longest opens one, then what fills it best goes in, looked for two at a time."""
    counts, out = counts.copy(), []
    lengths = np.arange(capacity + 1)
    for top in np.flatnonzero(counts)[::-1].tolist():
        while counts[top]:
            inside, room = Counter({top: 1}), capacity - top
            counts[top] -= 1
            while room:
                there = np.flatnonzero(counts[: room + 1])
                if not len(there):
                    break
                below = np.maximum.accumulate(np.where(counts[: room + 1] > 0, lengths[: room + 1], 0))
                second = below[room - there]
                filled = there + np.where((second != there) | (counts[there] > 1), second, 0)
                best = int(there[len(there) - 1 - np.argmax(filled[::-1])])
                inside[best] += 1
                counts[best] -= 1
                room -= best
            more = min(int(counts[size]) // times for size, times in inside.items())
            for size, times in inside.items():
                counts[size] -= more * times
            out.append((1 + more, tuple(inside.items())))
    return out


def pack(length: np.ndarray, capacity: int, full: int, function: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each piece its sequence and offset; the number of sequences, and the gap: what the function leaves of them unfilled, in its own units."""
    counts = np.bincount(length, minlength=capacity + 1)
    found = min((f(counts, capacity) for f in (by_document, by_sequence)), key=lambda patterns: sum(n for n, _ in patterns))
    order = np.argsort(length, kind="stable")
    at = (np.cumsum(counts) - counts).tolist()  # in `order`, the next piece of each length
    bin_, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    bins = 0
    for number, inside in found:
        filled = 0
        for size, times in inside:
            rows = order[at[size] : at[size] + number * times]
            bin_[rows] = np.repeat(np.arange(bins, bins + number), times)
            offset[rows] = filled + np.tile(np.arange(times) * size, number)
            at[size] += number * times
            filled += size * times
        bins += number
    return bin_, offset, bins, bins * full - int(function @ counts)


# --- rounds


def length_counts(rows: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces have each length."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # a row for each length
        counts[r["length"]] = r["count"]
    return counts


def _packed(rows: DataFrame, parts: int, number: int, capacity: int, full: int, function: np.ndarray) -> DataFrame:
    """`rows` dealt to `parts` partitions and packed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        bin_, offset, bins, gap = pack(table.column("length").to_numpy(), capacity, full, function)
        columns = [*(table.column(n).combine_chunks() for n in _NAMES), table.column("part").combine_chunks(), bin_, offset, np.full(len(bin_), gap), np.full(len(bin_), bins)]
        out = pa.Table.from_batches([_record(_PACKED, columns)])
        release_memory()
        return out

    dealt = rows.select(*_NAMES, F.pmod(F.xxhash64("key", F.lit(number)), F.lit(parts)).cast("int").alias("part"))
    return stored(dealt.groupBy("part").applyInArrow(run, _PACKED), "packed")


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0


def best_fit(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with their sequence_id and offset.

    Ids of sequences are negative for full pieces; else they hold the round, the
    partition and the sequence in it.
    """
    spark = rows.sparkSession
    small = rows.where(F.col("length") < capacity)
    out = [rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})]

    def keep(df: DataFrame, number: int) -> None:
        place = F.lit(number).cast("long") * (1 << 56) + F.col("part").cast("long") * (1 << 32) + F.col("bin")
        out.append(df.withColumn("sequence_id", place))

    counts = length_counts(small, capacity)
    total, full, function = binding(counts, capacity)
    parts = max(shuffle_partitions(spark), math.ceil(int(counts.sum()) / PIECES))
    packed = _packed(small, parts, 0, capacity, full, function)
    spare = _bins(packed) - -(-total // full)  # sequences beyond the bound
    for number in range(ROUNDS + 1):
        open_ = packed.where("gap > 0")
        before, left = _bins(open_), open_.count()
        if not left or not spare or number == ROUNDS:
            break
        parts = max(math.ceil(left / PIECES), parts // FEWER)
        again = _packed(open_, parts, number + 1, capacity, full, function)
        saved = before - _bins(again)
        if saved <= 0:
            break
        keep(packed.where("gap <= 0"), number)
        packed, spare = again, spare - saved
    keep(packed, number)
    columns = [*_NAMES, "sequence_id", "offset"]
    total = out[0].select(columns)
    for df in out[1:]:
        total = total.unionByName(df.select(columns))
    return total


def best_fit_packing(df: DataFrame, tokenizer_path: str, pattern: str = SUPPORTED, end_token: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See the module."""
    found = stored(pieces(df, tokenizer_path, pattern, end_token, capacity, id_col, text_col), "pieces")
    return best_fit(found, capacity).drop("key")


def certificate(packed: DataFrame, capacity: int = 1024) -> dict[str, int]:
    """Sequences of a packing, and the bound that no packing of its pieces is under."""
    counts = length_counts(packed, capacity)
    return {"sequences": packed.agg(F.countDistinct("sequence_id")).first()[0], "bound": lower_bound(counts, capacity)}
