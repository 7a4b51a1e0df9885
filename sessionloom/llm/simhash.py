"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within `BITS` differing bits agree in at least one of `BITS` + 1
blocks of their bits, so distinct fingerprints are dealt by (block, value), and
each such group is a binary trie over the other bits. The trie is joined with
itself: node pairs go down together, each step adds the differing bit, and a
pair is dropped when it exceeds the budget or when all leaves below both nodes
are known to be of one component. A group above `GROUP` fingerprints is dealt
again by blocks of the bits that are left, which loses no pair either.

Within a task links become a forest; forests are joined to components by
alternating star contractions on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import checkpointed, join_to_one, keyed_text, shuffle_partitions, slices

BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in a group before it is dealt again.
GROUP = 4096
#: Node pairs that go down together at most.
PAIRS = 1 << 18
#: Fingerprints in a partition of the join, about.
PARTITION = 100_000
#: Hot keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 50_000
U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is in over half of the XXH64 hashes of the text's shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(lengths) - 1
    start = end - lengths + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[x:y], seed) for x, y in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed long, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    docs = keyed_text(df, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, fp long")


def split_bits(mask: int, parts: int) -> list[int]:
    """The set bits of `mask` in `parts` masks of nearly equal size, lowest bits first."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: How often a hot group is dealt again before its trie is joined as it is.
LEVELS = 3


def _blocks(used: list[int]) -> dict[int, list[int]]:
    """For each set of bits already used, the blocks of the others."""
    return {u: split_bits(((1 << 64) - 1) & ~u, BITS + 1) for u in used}


def _deal(rows: DataFrame, blocks: dict[int, list[int]]) -> DataFrame:
    """`rows` (fp, used, grp) once for each block of the bits that are left; the block's value refines the group."""
    choices = F.create_map(*[x for u, masks in blocks.items() for x in (F.lit(_signed(u)), F.array(*[F.lit(_signed(m)) for m in masks]))])
    rows = rows.select("fp", "used", "grp", F.explode(choices[F.col("used")]).alias("mask"))
    return rows.select("fp", F.expr("used | mask").alias("used"), F.expr("xxhash64(grp, mask, fp & mask)").alias("grp"))


def _groups(nodes: DataFrame) -> DataFrame:
    """(fp, grp): each fingerprint in its groups, hot groups dealt again by further blocks."""
    blocks = _blocks([0])
    rows = _deal(nodes.select("fp", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("grp")), blocks)
    out = None
    for _ in range(LEVELS):
        hot = checkpointed(rows.groupBy("grp").count().where(F.col("count") > GROUP).select("grp"))
        n_hot = hot.count()
        if not n_hot:
            break
        hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        cold = rows.join(hot, "grp", "left_anti").select("fp", "grp")
        out = cold if out is None else out.unionAll(cold)
        blocks = _blocks([u | m for u, masks in blocks.items() for m in masks])
        rows = checkpointed(_deal(rows.join(hot, "grp", "left_semi").select("fp", "used", "grp"), blocks))
    rows = rows.select("fp", "grp")
    return rows if out is None else out.unionAll(rows)


class _Union:
    """Components of the leaves of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.until = np.arange(1, n + 1)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        while len(x):
            a, b = root[x], root[y]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, high[apart], low[apart])
            while True:
                deeper = root[root]
                if (deeper == root).all():
                    break
                root[:] = deeper
        cut = np.flatnonzero(np.append(root[1:] != root[:-1], True)) + 1
        self.until = cut[np.searchsorted(cut, np.arange(len(root)), side="right")]

    def together(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Are all leaves of both ranges known to be of one component?"""
        return (self.until[lo1] >= hi1) & (self.until[lo2] >= hi2) & (self.root[lo1] == self.root[lo2])


def trie_join(fp: np.ndarray, group: np.ndarray, budget: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (fingerprint, root) between fingerprints of one group within `budget` bits.

    fp: unsigned; a trie node at depth d is a run of the sorted fingerprints
    that share a group and d leading bits. All groups' tries go down together.
    """
    order = np.lexsort((fp, group))
    fp, group = fp[order], group[order]
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    zeros = [np.append(0, np.cumsum(fp >> U(63 - d) & U(1) ^ U(1))).astype(np.int64) for d in range(64)]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    tail = np.append(head[1:], n)
    many = tail - head > 1
    union = _Union(n)
    head, tail = head[many], tail[many]
    stack = [(0, head, tail, head, tail, np.zeros(len(head), dtype=np.int8))]
    while stack:
        depth, lo1, hi1, lo2, hi2, used = stack.pop()
        if len(lo1) > PAIRS:
            for x in range(0, len(lo1), PAIRS):
                stack.append((depth, *(a[x : x + PAIRS] for a in (lo1, hi1, lo2, hi2, used))))
            continue
        # pairs of single leaves are compared at once
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            x, y = lo1[leaf], lo2[leaf]
            near = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= budget)
            if near.any():
                union.join(x[near], y[near])
        go = ~leaf & ~union.together(lo1, hi1, lo2, hi2)
        if depth == 64:
            # equal fingerprints of one group
            union.join(lo1[go], lo2[go])
            continue
        lo1, hi1, lo2, hi2, used = (a[go] for a in (lo1, hi1, lo2, hi2, used))
        if not len(lo1):
            continue
        z = zeros[depth]
        mid1, mid2 = lo1 + z[hi1] - z[lo1], lo2 + z[hi2] - z[lo2]
        same = lo1 == lo2
        pairs = [
            (lo1, mid1, lo2, mid2, used, None),
            (mid1, hi1, mid2, hi2, used, None),
            (lo1, mid1, mid2, hi2, used + 1, used < budget),
            (mid1, hi1, lo2, mid2, used + 1, (used < budget) & ~same),
        ]
        parts = []
        for a1, b1, a2, b2, u, ok in pairs:
            full = (a1 < b1) & (a2 < b2)
            full = full if ok is None else full & ok
            parts.append([v[full] for v in (a1, b1, a2, b2, u)])
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*parts, strict=True))))
    linked = np.flatnonzero(union.root != np.arange(n))
    return fp[linked], fp[union.root[linked]]


def _links(nodes: DataFrame, n_nodes: int) -> DataFrame:
    spark = nodes.sparkSession
    parts = max(shuffle_partitions(spark), (BITS + 1) * n_nodes // PARTITION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("fp").to_numpy(), b.column("grp").to_numpy()) for b in batches]
        if held:
            fp, grp = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = trie_join(fp.view(np.uint64), grp)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _groups(nodes).repartition(parts, "grp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): the least node that can be reached.

    Alternates large-star and small-star steps; each is one aggregation with
    partial minima and one join, in which nodes of very many edges are not
    shuffled, and the edges are checkpointed after each.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())

    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_to_one(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        # now every a is above its b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_to_one(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    Texts are lower-cased in A-Z, split at white space 0x20 and 0x09-0x0D and
    taken as shingles of four words. Documents link at four or fewer differing
    bits; component_id is the least doc_id that can be reached. A null text is
    an empty one, with fingerprint zero; rows of equal text or equal id keep a
    row each; a null id never is a component's id unless there is no other,
    when the component's id is null; an empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(df, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(_links(nodes.select("fp"), nodes.count()))
    labelled = checkpointed(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = join_to_one(labelled, least, "root").select("fp", "component_id")
    return join_to_one(prints, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
