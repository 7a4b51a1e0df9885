"""Benchmark decontamination by a distributed positional inverted index.

The documents are indexed in shards: each shard, a slice of a scan, keeps for
every term the ascending list of its positions. The index is a stored table,
one row per shard, that any test table can be searched in without reading the
documents again. A search takes each window of ten test words, starts from the
list of its rarest term in the shard, shifts it to the window's start and
intersects it with the shifted lists of the next rarer terms: what is left are
exact phrases. Where terms are near their places, a proximity match is sought:
a start for which every term is within `slop` words of its place.

The test table becomes blocks of windows on the cluster. Blocks go to the
shards in broadcasts of a bounded size, and a shard is searched for all blocks
of a broadcast in one reading of the index: a stated query set run over all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import keyed_text, release_memory, stored, text_bytes
from sessionloom.llm.rolling import merged

WINDOW = 10
#: Bytes of test text in a block, about, and of blocks in a broadcast (one block at least).
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 64 << 20
#: Bytes of text in an index shard.
SHARD_BYTES = 4 << 20
#: Candidates that are intersected at once.
CANDIDATES = 1 << 18
#: Positions between documents of a shard, so that no window and no neighbourhood reaches from one into another.
GAP = 4 * WINDOW

#: Lower-cases A-Z and turns every other byte under 0x80 that is no letter or digit into a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class TestSet:
    """Distinct windows of a block of test items, as term numbers, and the items of each."""

    __test__ = False

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        terms: dict[bytes, int] = {}
        rows: dict[tuple, set[str]] = {}
        for item, found in items:
            ids = [terms.setdefault(w, len(terms)) for w in found]
            spans = [ids[i : i + window] for i in range(len(ids) - window + 1)] if len(ids) >= window else [ids] * bool(ids)
            for s in spans:
                rows.setdefault(tuple(s), set()).update([str(item)] if item is not None else [])
        self.terms = pa.array(list(terms), pa.binary())
        self.items = [sorted(v) for v in rows.values()]
        self.length = np.array([len(r) for r in rows], dtype=np.int64)
        self.term = np.full((len(rows), window), -1, dtype=np.int32)
        for i, r in enumerate(rows):
            self.term[i, : len(r)] = r


# --- the index

_INDEX = "shard long, ids binary, lengths binary, terms binary, counts binary, positions binary"


def _ipc(array: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", array.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([array], names=["x"]))
    return sink.getvalue().to_pybytes()


def _of_ipc(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("x").combine_chunks()


def index_row(ids: list, texts: list) -> tuple:
    """A shard of the index: ids, words in each document, terms, and the postings of each term.

    Positions count through the shard, with a gap after each document.
    """
    found = [words(t) for t in texts]
    lengths = np.array([len(w) for w in found], dtype=np.int64)
    coded = pa.array([w for f in found for w in f], pa.binary()).dictionary_encode()
    del found
    starts = np.cumsum(lengths + GAP) - (lengths + GAP)
    code = coded.indices.to_numpy()
    position = np.arange(len(code)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    order = np.argsort(code, kind="stable")
    count = np.bincount(code, minlength=len(coded.dictionary))
    return _ipc(pa.array(ids, pa.int64())), lengths.tobytes(), _ipc(coded.dictionary), count.astype(np.int32).tobytes(), position[order].astype(np.int32).tobytes()


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per shard of at most `SHARD_BYTES` of text (one document at least).

    It keeps postings of all terms, so it serves every test table; the scan is
    not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, first = [], [], 0, None

        def row() -> pa.RecordBatch:
            cells = index_row(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["shard", "ids", "lengths", "terms", "counts", "positions"])

        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column("text")[at].as_py() or ""
                if ids and size + len(text) > SHARD_BYTES:
                    yield row()
                    ids, texts, size = [], [], 0
                if not ids:
                    first = batch.column("row")[at].as_py()
                ids.append(batch.column("doc_id")[at].as_py())
                texts.append(text)
                size += len(text)
        if ids:
            yield row()
        ids, texts = [], []
        release_memory()

    docs = keyed_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(docs.mapInArrow(run, _INDEX), "index")


class Shard:
    """Postings of one index row."""

    def __init__(self, lengths: np.ndarray, terms: pa.Array, count: np.ndarray, position: np.ndarray):
        self.starts = np.cumsum(lengths + GAP) - (lengths + GAP)
        self.terms, self.count, self.position = terms, count.astype(np.int64), position.astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.width = int((lengths + GAP).sum()) + GAP
        # all lists as one ascending list: term by term
        self.all = np.repeat(np.arange(len(count)), self.count) * self.width + self.position

    def _holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Is there a posting of the term in [low, high]?"""
        key = term * self.width
        at = np.searchsorted(self.all, key + np.maximum(low, 0))
        return (at < len(self.all)) & (self.all[np.minimum(at, len(self.all) - 1)] <= key + high) & (high >= 0)

    def search(self, tests: TestSet, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact (window, start) pairs, and proximity (window, a position in the document) pairs."""
        none = np.empty(0, dtype=np.int64)
        if not len(self.all) or not len(tests.term):
            return none, none, none, none
        local = pc.fill_null(pc.index_in(tests.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        used = tests.term >= 0
        term = np.where(used, local[tests.term], -1)
        live = np.flatnonzero(((term >= 0) == used).all(axis=1))
        if not len(live):
            return none, none, none, none
        term, used = term[live], used[live]
        freq = np.where(used, self.count[term], np.iinfo(np.int64).max)
        rank = np.argsort(freq, axis=1, kind="stable")  # rarest first
        term = np.take_along_axis(term, rank, axis=1)
        n = np.take_along_axis(freq, rank[:, :1], axis=1)[:, 0]
        exact, near = [], []
        edge = np.append(0, np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1)
        for x, y in zip(edge, np.append(edge[1:], len(live)), strict=True):
            w = np.repeat(np.arange(x, y), n[x:y])
            inside = np.arange(len(w)) - np.repeat(np.cumsum(n[x:y]) - n[x:y], n[x:y])
            place = self.position[self.begin[term[w, 0]] + inside]
            w, place, loose = self._intersect(term, rank, w, place, slop)
            exact.append((live[w[~loose]], (place - rank[w, 0])[~loose]))
            w, place = w[loose], place[loose]
            ok = np.zeros(len(w), dtype=bool)
            for shift in range(-slop, slop + 1):
                ok |= self._all_near(term, rank, w, place - rank[w, 0] + shift, slop)
            near.append((live[w[ok]], place[ok]))
        return tuple(np.concatenate([p[i] for p in part]) for part in (exact, near) for i in (0, 1))

    def _intersect(self, term: np.ndarray, rank: np.ndarray, w: np.ndarray, place: np.ndarray, slop: int) -> tuple:
        """Candidates whose terms all stand at their places, or (loose) so near that a start within `slop` may have them near."""
        loose = np.zeros(len(w), dtype=bool)
        for k in range(1, term.shape[1]):
            if not len(w):
                break
            of = term[w, k]
            at = place - rank[w, 0] + rank[w, k]
            ok = of < 0
            real = np.flatnonzero(~ok)
            ok[real] = self._holds(of[real], at[real], at[real])
            miss = np.flatnonzero(~ok)
            loose[miss] = True
            ok[miss] = self._holds(of[miss], at[miss] - 2 * slop, at[miss] + 2 * slop)
            w, place, loose = w[ok], place[ok], loose[ok]
        return w, place, loose

    def _all_near(self, term: np.ndarray, rank: np.ndarray, w: np.ndarray, start: np.ndarray, slop: int) -> np.ndarray:
        out = np.ones(len(w), dtype=bool)
        for k in range(term.shape[1]):
            i = np.flatnonzero(out & (term[w, k] >= 0))
            at = start[i] + rank[w[i], k]
            out[i] = self._holds(term[w[i], k], at - slop, at + slop)
        return out


# --- the search


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, size, tests): the test table's windows in blocks of about `block_bytes` of text, a stored table."""
    rows = keyed_text(benchmark, item_col, text_col).distinct()  # equal rows would meet in one block, and say nothing more
    blocks = max(1, math.ceil(text_bytes(rows, "text") / block_bytes))

    def run(table: pa.Table) -> pa.Table:
        items = zip(table.column("doc_id").to_pylist(), map(words, table.column("text").to_pylist()), strict=True)
        data = pickle.dumps(TestSet([i for i in items if i[1]]))
        return pa.table({"block": table.column("block").slice(0, 1), "size": pa.array([len(data)], pa.int64()), "tests": pa.array([data], pa.binary())})

    dealt = rows.where("text IS NOT NULL").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    return stored(dealt.groupBy("block").applyInArrow(run, "block int, size long, tests binary"), "tests")


test_blocks.__test__ = False

_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "shard long, nth long, doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>, near_items array<string>"


def _search(index: DataFrame, blocks: list[bytes], slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pickle.loads(b) for b in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):  # one shard at a time
                yield _answer(batch.slice(i, 1).to_pylist()[0], held, slop)
        release_memory()

    return index.mapInArrow(run, _FOUND)


def _answer(row: dict, blocks: list[TestSet], slop: int) -> pa.RecordBatch:
    ids = _of_ipc(row["ids"])
    lengths = np.frombuffer(row["lengths"], dtype=np.int64)
    shard = Shard(lengths, _of_ipc(row["terms"]), np.frombuffer(row["counts"], dtype=np.int32), np.frombuffer(row["positions"], dtype=np.int32))
    hits: list[list] = [[] for _ in lengths]
    items: list[set] = [set() for _ in lengths]
    near: list[set] = [set() for _ in lengths]
    starts, ends = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

    def note(to: list[set], tests: TestSet, window: np.ndarray, place: np.ndarray) -> None:
        doc = np.searchsorted(shard.starts, place, side="right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            to[d].update(tests.items[w])

    for tests in blocks:
        w, s, near_w, near_place = shard.search(tests, slop)
        starts.append(s)
        ends.append(s + tests.length[w])
        note(items, tests, w, s)
        note(near, tests, near_w, near_place)
    start, end = merged(np.concatenate(starts), np.concatenate(ends))
    doc = np.searchsorted(shard.starts, start, side="right") - 1
    for d, x, y in zip(doc.tolist(), (start - shard.starts[doc]).tolist(), (end - shard.starts[doc]).tolist(), strict=True):
        hits[d].append({"start": x, "end": y})
    columns = [
        pa.array([row["shard"]] * len(ids), pa.int64()),
        pa.array(range(len(ids)), pa.int64()),
        ids,
        pa.array(lengths, pa.int64()),
        pa.array(hits, _HIT),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array([sorted(n - x) for n, x in zip(near, items, strict=True)], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _FOUND.split(", ")])


def search_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each indexed document what `decontaminate` returns; the documents are not read.

    Blocks that fit in one broadcast need one pass over the index. With more,
    each pass is stored and the driver holds one broadcast at a time.
    """
    blocks = test_blocks(benchmark, item_col, item_text_col, block_bytes)
    groups: list[list[int]] = [[]]
    held = 0
    for r in blocks.select("block", "size").orderBy("block").collect():
        if groups[-1] and held + r["size"] > BROADCAST_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r["block"])
        held += r["size"]

    def passed(group: list[int]) -> DataFrame:
        rows = blocks.where(F.col("block").isin(group)).select("block", "tests").orderBy("block").collect() if group else []
        return _search(index, [bytes(r["tests"]) for r in rows], slop)

    out = passed(groups[0]) if len(groups) == 1 else _united([stored(passed(g), "pass") for g in groups])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    out = out.select("doc_id", "n_words", "hits", n_hit.alias("n_hit"), "items", "near_items", F.size("items").cast("long").alias("n_items"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).withColumn("contaminated", F.col("n_hit") > 0)


def _united(passes: list[DataFrame]) -> DataFrame:
    """One row per document from several passes; a document is known by its place in the index."""
    rows = reduce(DataFrame.unionAll, passes).groupBy("shard", "nth").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    union = F.aggregate(
        "hits",
        F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= h["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(h))),
    )
    return rows.select("doc_id", "n_words", union.alias("hits"), "items", F.array_sort(F.array_except("near_items", "items")).alias("near_items"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of each document occurs in the test table: `build_index`, then `search_index`.

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. A window is ten consecutive words of an item, or the whole of
    a shorter item. Returns doc_id, n_words, hits (disjoint ranges of hit
    words), n_hit, items (with exact windows; as strings, sorted), near_items
    (with proximity matches only), n_items, items_sha256, contaminated.

    A null or empty text has no words; items without words are passed over, and
    items with a null id make hits but are not listed; an empty test table
    leaves every document clean; repeated document rows give a result each; an
    empty table gives an empty result.
    """
    return search_index(build_index(df, id_col, text_col), benchmark, item_col, item_text_col, slop, block_bytes)
