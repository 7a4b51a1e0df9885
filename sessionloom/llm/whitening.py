"""Whitening of embeddings, exact up to the eigenvectors.

Entries become integers. Products of integers are summed by float64 BLAS, which
is exact as long as no sum passes 2**53: each centred integer is split into
signed digits of `DIGIT` bits, matrices of digits are multiplied, and the
products are put together again at their places (`Gram`). Tasks send their sums,
digit by digit; these are added without rounding. Only the covariance itself, a
quotient of two integers, is rounded, and then decomposed on the driver: it has
the size of the dimensions, whatever the number of rows.

Vectors are centred before they are multiplied: by the whole part of the mean,
so that they stay integers; the fraction that is left is taken off exactly.

Which rows count: a row whose vector is null, or holds a null or non-finite
entry, is dropped, and so is one whose length is not the most common length of
the others (the longest of several). Null and repeated ids, and repeated rows,
count as they are. An empty table, or one without such vectors, gives an empty
result. A component without variance has `whitened` null, and takes no part in
identity_error. Whole numbers are held within plus or minus 2**61.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import checkpointed, importable, release_memory, stored

#: Bits of a digit, and rows of one product: ROWS * 2**(2 * DIGIT - 2) is 2**53.
DIGIT = 18
ROWS = 1 << 19
#: Rows that are turned into a matrix at once.
BATCH = 1 << 13
#: Products that are added up before carries are taken on.
CARRY_AFTER = 256
#: Groups in which sums of one matrix row are added first.
PARTS = 64

_MOST = 2.0**61


def whole_numbers(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as int64."""
    return np.clip(np.floor(scale * entries), -_MOST, _MOST).astype(np.int64) + shift


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits of int64 values, least first, as float64: x = sum of digit[k] * 2**(DIGIT * k)."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((x + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> DIGIT
        if not x.any():
            return out


class Gram:
    """The exact sum of products y.T @ y of integer rows, as int64 levels: their sum is level[k] * 2**(DIGIT * k)."""

    def __init__(self, size: int):
        self.levels = [np.zeros((size, size), dtype=np.int64)]
        self._added = 0

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            self.levels.append(np.zeros_like(self.levels[0]))
        return self.levels[k]

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            parts = digits(y[at : at + ROWS])
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    level = self._level(i + j)
                    level += (a.T @ b).astype(np.int64)
            self._added += len(parts)
            if self._added >= CARRY_AFTER:
                self.carry()

    def carry(self) -> None:
        """Leaves signed digits in all levels."""
        k, half = 0, 1 << (DIGIT - 1)
        while k < len(self.levels):
            over = (self.levels[k] + half) >> DIGIT
            if over.any():
                self.levels[k] -= over << DIGIT
                following = self._level(k + 1)
                following += over
            k += 1
        self._added = 0


def recombined(levels: list[np.ndarray]) -> np.ndarray:
    """Levels as Python integers."""
    return sum(level.astype(object) << (DIGIT * k) for k, level in enumerate(levels))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as float64, and the length and start of each row's vector; of length -1 if the row is dropped."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    bad = np.append(0, np.cumsum(~np.isfinite(entries)))
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (bad[start + length] == bad[start])
    return entries, np.where(fine, length, -1), start


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)
    release_memory()


@dataclass(frozen=True)
class Whitening:
    """n, sums and size of the fit list; eigenvalues, falling, and components of the covariance of x."""

    scale: int
    shift: int
    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """n times what the mean has beyond its whole part."""
        return [s % self.n for s in self.sums]

    @property
    def rank(self) -> int:
        """Components that have variance."""
        floor = self.size * np.finfo(float).eps * max(self.eigenvalues[0], 0) if len(self.eigenvalues) else 0
        return int((self.eigenvalues > floor).sum())

    def centred(self, entries: np.ndarray, start: np.ndarray) -> np.ndarray:
        x = entries[start[:, None] + np.arange(self.size)]
        return whole_numbers(x, self.scale, self.shift) - self.centre

    def deviations(self, y: np.ndarray) -> list[int]:
        """For each row the sum over dimensions of (n * x - sum)**2, as Python integers."""
        n, rest = self.n, self.rest
        most = int(np.abs(y).max(initial=0))
        if self.size * max(most, 1) * max(most, *rest, 1) < 2**62:
            squares = (y * y).sum(axis=1).astype(object)
            cross = (y @ np.array(rest, dtype=np.int64)).astype(object)
            return (n * n * squares - 2 * n * cross + sum(r * r for r in rest)).tolist()
        z = n * y.astype(object) - np.array(rest, dtype=object)
        return (z * z).sum(axis=1).tolist()

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows projected on the components with variance, in units of their deviation."""
        k = min(self.rank, len(self.components))
        rest = np.array([r / self.n for r in self.rest])
        return (y.astype(np.float64) - rest) @ (self.components[:k] / np.sqrt(self.eigenvalues[:k])[:, None]).T


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    importable(df.sparkSession)
    return df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))


def _sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """n and the sums of the vectors of the most common length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # length: rows, and sums of the high and of the low halves
        for batch in _batches(batches):
            entries, length, start = _vectors(batch.column("vector"))
            for size in np.unique(length[length >= 0]).tolist():
                x = whole_numbers(entries[start[length == size][:, None] + np.arange(size)], scale, shift)
                n, high, low = held.setdefault(size, [0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)])
                held[size] = [n + len(x), high + (x >> 31).sum(axis=0), low + (x & 0x7FFFFFFF).sum(axis=0)]
        sizes = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array([held[s][0] for s in sizes], pa.int64()), *(pa.array([held[s][k] for s in sizes], pa.list_(pa.int64())) for k in (1, 2))],
            names=["size", "n", "high", "low"],
        )

    partial = checkpointed(rows.select("vector").mapInArrow(run, "size int, n long, high array<long>, low array<long>"))
    most = partial.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    entry = partial.where(F.col("size") == most["size"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "x"))
    # of partial sums, each of at most 2**31 times a task's rows, the low halves are added as decimals
    summed = entry.groupBy("i").agg(F.sum(F.col("x.high").cast("decimal(19,0)")).alias("high"), F.sum(F.col("x.low").cast("decimal(19,0)")).alias("low"))
    return most["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in summed.orderBy("i").collect()]


def _gram(rows: DataFrame, scale: int, shift: int, centre: np.ndarray) -> np.ndarray:
    """The exact sum of products of the centred vectors, as Python integers."""
    size = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(size)
        for batch in _batches(batches):
            entries, length, start = _vectors(batch.column("vector"))
            x = entries[start[length == size][:, None] + np.arange(size)]
            if len(x):
                gram.add(whole_numbers(x, scale, shift) - centre)
        gram.carry()
        n = len(gram.levels)
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(size), n), pa.int32()),
                pa.array(np.repeat(np.arange(n), size), pa.int32()),
                pa.array(np.full(n * size, part), pa.int32()),
                pa.array([row for level in gram.levels for row in level], pa.list_(pa.int64())),
            ],
            names=["i", "level", "part", "sums"],
        )

    def total(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
        first = table.slice(0, 1)
        return pa.table([first.column("i"), first.column("level"), first.column("part"), pa.array([sums], pa.list_(pa.int64()))], names=["i", "level", "part", "sums"])

    kind = "i int, level int, part int, sums array<long>"
    parts = rows.select("vector").mapInArrow(run, kind).groupBy("i", "level", "part").applyInArrow(total, kind)
    found = parts.groupBy("i", "level").applyInArrow(total, kind).collect()
    levels = [np.zeros((size, size), dtype=np.int64) for _ in range(max((r["level"] for r in found), default=0) + 1)]
    for r in found:
        levels[r["level"]][r["i"]] = r["sums"]
    return recombined(levels)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The whitening of all remaining vectors of `df`; None if there are none.

    Two passes: sums, then products of the centred vectors. The covariance is
    (n * G - r r.T) / n**2, of integers: G sums the products, r = S - n * centre.
    """
    rows = _rows(df, id_col, vector_col)
    n, sums = _sums(rows, scale, shift)
    if not n or not sums:
        return None
    model = Whitening(scale, shift, n, tuple(sums), np.empty(0), np.empty((0, len(sums))), 0.0)
    g, r = _gram(rows, scale, shift, model.centre), np.array(model.rest, dtype=object)
    numerator = n * g - np.outer(r, r)
    covariance = np.array([[x / (n * n) for x in row] for row in numerator.tolist()])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:components]
    return Whitening(scale, shift, n, tuple(sums), values[order], vectors[:, order].T.copy(), sum(numerator.diagonal().tolist()) / (n * n))


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (decimal, exact, null beyond 38 digits) and whitened (array) of every row that counts."""
    rows = _rows(df, id_col, vector_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _batches(batches):
            entries, length, start = _vectors(batch.column("vector"))
            kept = np.flatnonzero(length == model.size)
            y = model.centred(entries, start[kept])
            deviation = [d if d < 10**38 else None for d in model.deviations(y)] if len(y) else []
            w = model.whitened(y)
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(kept)), pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return rows.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of `whitened`, its first k entries, minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return None
    w = whitened.select(*(F.col("whitened")[i].alias(f"w{i}") for i in range(k)))
    found = w.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))


def whitening(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Each remaining row by component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    The whitened rows are written once; their covariance is measured on what was
    written, by Spark's own centred moments. See the module for odd rows.
    """
    spark = df.sparkSession
    model = fit(df, id_col, vector_col, components, scale, shift)
    kind = _rows(df, id_col, vector_col).schema["vec_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = stored(whiten(df, model, id_col, vector_col), "whitened")
    error = identity_error(rows, min(model.rank, len(model.components)))
    explained = [max(float(e), 0.0) / model.trace if model.trace else 0.0 for e in model.eigenvalues]
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("component"), F.get("whitened", F.lit(k)).alias("whitened"), F.lit(e).alias("explained")) for k, e in enumerate(explained))))
    out = rows.select("vec_id", "deviation", each.alias("c"))
    return out.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
