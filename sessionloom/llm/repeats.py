"""Repeated passages across a corpus: documents in shards, what may repeat in blocks.

Two operators share this module; they differ in the symbols (words or bytes),
in the window, in which occurrences go, and in how a block decides:

* `substring_dedup`: words; an occurrence of a window goes if it is not the
  first in (doc_id, start) order. A block is an indexed reference text against
  which passages are factored (`factors`).
* `suffix_array_dedup`: bytes; every occurrence of a repeated window goes. A
  block sorts the suffixes of its passages (`rolling.verified_order`).

How it runs. Documents are dealt to shards. In each shard every window chooses
an anchor, the gram of least hash in it, so that equal windows have equal
anchors at equal offsets. The windows that chose one anchor, as one piece of
text, are its *passage*.

1. Shards send the hashes of their anchors, once for each distinct passage and
   at most `VARIANTS` for one anchor. Bins answer which anchors occur again, and
   how many passages there are.
2. Of an anchor with over `UNSPLIT` passages, such as one in a line that very
   many documents hold in differing surroundings, shards announce the hash of
   every window. Bins answer which of these occur again: those inside the line,
   and not those over its edges.
3. A shard sends each distinct passage of an anchor that occurs again, as text,
   to the block that the anchor's hash names; of an anchor with very many
   passages each window that occurs again, to the block that the window's hash
   names. Copies within the shard are found by comparing texts and are not sent.
   So a key gets at most `UNSPLIT` passages, or one window from each shard.
4. A block has every passage that can share a window. It decides by comparing
   texts, and answers with ranges.
5. Shards unite the ranges and give each document's result.

Hashes route, they never decide: equality is always found by words or bytes.
Blocks and shards are as many as the input's size asks; nothing is collected on
the driver but one sum. Documents are shuffled once; the four passes read the
same exchange. Windows of a long document are worked off piece by piece.

Nulls and ties: a null text is an empty one; null ids go last in the order of
ids; rows of the same id are ordered as they are read and count as separate
documents; an empty table gives an empty result. Rows are dealt by their place
as well as by their id, so repeated or null ids do not gather in one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import rolling
from sessionloom.llm.common import keyed_text, release_memory, shard_count, stored, text_bytes
from sessionloom.llm.factors import Reference
from sessionloom.llm.rolling import Prefix, U

#: Bytes of text in a shard, and in what is hashed at once.
SHARD_BYTES = 4 << 20
CHUNK_BYTES = 1 << 19

#: Passages of one anchor that a shard announces one by one; more are announced as a number.
VARIANTS = 4
#: Passages of one anchor up to which its windows stay together.
UNSPLIT = 2048
#: What `known` says of a hash: an anchor, an anchor whose windows are told apart, or such a window.
WHOLE, SPLIT, WINDOW = 0, 1, 2

_LAST = np.iinfo(np.int64).max
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ANCHOR = "bin int, shard int, gram long, passage int, number int"
_KNOWN = "shard int, gram long, split int"
_WINDOWS = "bin int, shard int, hashes binary"
_PASSAGE = "bin int, own boolean, shard int, seq long, rank long, start long, n long, offset int, copies boolean, gram long, text binary"
_RANGE = "shard int, seq long, start long, n long"
_RESULT = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"

_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _table(schema: str, *columns) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(column, type=_KINDS[kind]) for (name, kind), column in zip(fields, columns, strict=True)})


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


@dataclass(frozen=True)
class Piece:
    """Symbols of a document from the window that starts at `base` on; its windows are those that lie in it."""

    doc: int
    base: int
    data: bytes


def _pieces(doc: int, text: bytes, words: bool, size: int, chunk: int) -> Iterator[Piece]:
    """The text as it is, or pieces of it that overlap by a window less one symbol."""
    if len(text) <= 2 * chunk:
        yield Piece(doc, 0, text)
        return
    if not words:
        for at in range(0, max(len(text) - size + 1, 1), chunk):
            yield Piece(doc, at, text[at : at + chunk + size - 1])
        return
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    del space
    begin, end = edge[::2], edge[1::2]
    step = max(chunk // 6, 1)
    for at in range(0, max(len(begin) - size + 1, 1), step):
        yield Piece(doc, at, text[begin[at] : end[min(at + step + size - 1, len(end)) - 1]] if len(begin) else b"")


class _Chunk:
    """Some pieces as one run of symbols."""

    def __init__(self, pieces: list[Piece], words: bool):
        self.doc = np.array([p.doc for p in pieces], dtype=np.int64)
        self.base = np.array([p.base for p in pieces], dtype=np.int64)
        texts = [p.data for p in pieces]
        buf = np.frombuffer(b"".join(t + b" " for t in texts) if words else b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) + words for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        values = rolling.BYTE_VALUES[buf]
        if words:
            space = _SPACE[buf]
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            if len(buf) and not space[0]:
                edge = np.append(0, edge)
            begin, end = edge[::2], edge[1::2]  # every text ends with a space
            values = rolling.mix(Prefix(values).ranges(begin, end))
            starts, ends = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
        self.starts, self.ends = starts, ends
        self.prefix = Prefix(values)


class _Shard:
    """The documents of a shard in the order of their ids."""

    def __init__(self, table: pa.Table):
        ids, seq = table.column("doc_id").to_pylist(), table.column("seq").to_pylist()
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, seq[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.number = table.column("shard")[0].as_py()
        self.rank = np.array([_LAST if i is None else i for i in self.ids], dtype=np.int64)
        self.seq = np.array([seq[i] for i in order], dtype=np.int64)

    def pieces(self, words: bool, size: int, chunk: int) -> Iterator[Piece]:
        for i, t in enumerate(self.texts):
            yield from _pieces(i, t, words, size, chunk)

    def chunks(self, words: bool, size: int, chunk: int) -> Iterator[_Chunk]:
        held, n = [], 0
        for p in self.pieces(words, size, chunk):
            held.append(p)
            n += len(p.data)
            if n >= chunk:
                yield _Chunk(held, words)
                held, n = [], 0
        if held:
            yield _Chunk(held, words)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of `x` are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _hash32(x: np.ndarray) -> np.ndarray:
    return (x >> U(32)).astype(np.uint32).view(np.int32)


@dataclass(frozen=True)
class Plan:
    """The steps for one kind of symbols and window."""

    words: bool
    size: int
    gram: int
    first_stays: bool
    bins: int
    decide: Callable
    finish: Callable
    variants: int
    unsplit: int
    chunk: int

    def _chunks(self, shard: _Shard) -> Iterator[_Chunk]:
        return shard.chunks(self.words, self.size, self.chunk)

    # 1. shard: its anchors
    def announce(self, table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        grams, passages = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int32)]
        for chunk in self._chunks(shard):
            a = rolling.anchors(chunk.prefix, chunk.starts, chunk.ends, self.size, self.gram)
            grams.append(a.gram)
            passages.append(_hash32(rolling.mix(chunk.prefix.ranges(a.first, a.last + self.size))))
        gram, passage = np.concatenate(grams), np.concatenate(passages)
        order = np.lexsort((passage, gram))
        gram, passage = gram[order], passage[order]
        if len(gram):
            keep = np.append(True, (gram[1:] != gram[:-1]) | (passage[1:] != passage[:-1]))
            gram, passage = gram[keep], passage[keep]
            head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            count = np.diff(np.append(head, len(gram)))
            many = np.repeat(count > self.variants, count)
            keep = ~many
            keep[head] = True
            number = np.ones(len(gram), dtype=np.int32)
            number[head] = np.where(count > self.variants, count, 1)
            gram, passage, number = gram[keep], passage[keep], number[keep]
        else:
            number = np.empty(0, dtype=np.int32)
        bin_ = (gram % U(self.bins)).astype(np.int32)
        return _table(_ANCHOR, bin_, np.full(len(gram), shard.number, dtype=np.int32), gram.view(np.int64), passage, number)

    # 2. bin: which anchors occur again, and how far their windows are told apart
    def judge(self, table: pa.Table) -> pa.Table:
        shard, gram, passage, number = _numbers(table, "shard", "gram", "passage", "number")
        order = np.lexsort((shard, passage, gram))
        shard, gram, passage, number = (x[order] for x in (shard, gram, passage, number))
        new = np.append(True, gram[1:] != gram[:-1])
        of = np.cumsum(new) - 1
        again = (np.bincount(of) > 1)[of]
        distinct = new | np.append(True, passage[1:] != passage[:-1]) | (number > 1)
        passages = np.bincount(of, weights=np.where(distinct, number, 0))
        split = np.where(passages > self.unsplit, SPLIT, WHOLE).astype(np.int32)[of]
        known = np.unique(np.stack([gram, shard.astype(np.int64), split.astype(np.int64)])[:, again], axis=1)
        return _table(_KNOWN, known[1].astype(np.int32), known[0], known[2].astype(np.int32))

    # 3. shard: the windows of anchors with very many passages
    def announce_windows(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows or not known.num_rows:
            return _table(_WINDOWS, [], [], [])
        shard, found = _Shard(docs), [np.empty(0, dtype=np.uint64)]
        hot = np.sort(known.column("gram").to_numpy().view(np.uint64))
        for chunk in self._chunks(shard):
            a = rolling.anchors(chunk.prefix, chunk.starts, chunk.ends, self.size, self.gram)
            rows = np.flatnonzero(_among(a.gram, hot))
            start, _ = rolling.spread(a.first[rows], a.last[rows])
            found.append(np.unique(self._window_keys(chunk, start)))
        keys = np.unique(np.concatenate(found))
        bins, order = keys % U(self.bins), np.argsort(keys % U(self.bins), kind="stable")
        values, first = np.unique(bins[order], return_index=True)
        parts = np.split(keys[order], first[1:]) if len(keys) else []
        return _table(_WINDOWS, values.astype(np.int32), np.full(len(parts), shard.number, dtype=np.int32), [p.tobytes() for p in parts])

    def _window_keys(self, chunk: _Chunk, start: np.ndarray) -> np.ndarray:
        return rolling.mix(chunk.prefix.ranges(start, start + self.size) ^ U(0xA24BAED4963EE407))

    # 4. bin: which windows occur in several shards
    def judge_windows(self, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        shard = np.repeat(table.column("shard").to_numpy(), [len(p) for p in parts])
        keys = np.concatenate(parts)
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        return _table(_KNOWN, shard[again], keys[again].view(np.int64), np.full(int(again.sum()), WINDOW, dtype=np.int32))

    # 5. shard: the distinct passages of such anchors, and the ranges of copies within the shard
    def compare(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_PASSAGE, *[[]] * 11)
        shard = _Shard(docs)
        piece, start, last, offset, gram = self._selected(shard, known)
        seen: dict[bytes, int] = {}
        first: list[int] = []
        copy: list[int] = []
        copied: set[int] = set()
        texts: list[bytes] = []
        doc = np.empty(len(piece), dtype=np.int64)
        cut = np.searchsorted(piece, np.arange(piece[-1] + 2 if len(piece) else 1))
        for number, p in enumerate(shard.pieces(self.words, self.size, self.chunk)):
            if number + 1 >= len(cut):
                break
            x, y = int(cut[number]), int(cut[number + 1])
            if x == y:
                continue
            symbols = p.data.split() if self.words else p.data
            doc[x:y] = p.doc
            for i, s, e in zip(range(x, y), (start[x:y]).tolist(), (last[x:y] + self.size).tolist(), strict=True):
                text = b" ".join(symbols[s:e]) if self.words else symbols[s:e]
                k = seen.setdefault(text, len(first))
                if k == len(first):
                    first.append(i)
                    texts.append(text)
                else:
                    copy.append(i)
                    copied.add(k)
            start[x:y] += p.base
            last[x:y] += p.base
        gone = np.array(copy if self.first_stays else copy + [first[k] for k in sorted(copied)], dtype=np.int64)
        at, end = rolling.merged(start[gone] + (doc[gone] << 32), last[gone] + self.size + (doc[gone] << 32))
        own_doc, own_start, own_n = at >> 32, at & 0xFFFFFFFF, end - at
        i = np.array(first, dtype=np.int64)
        n = len(own_doc) + len(i)
        own = np.arange(n) < len(own_doc)
        of = np.append(own_doc, doc[i]).astype(np.int64)
        more = np.zeros(len(own_doc), dtype=np.int64)
        copies = np.zeros(len(i), dtype=bool)
        copies[sorted(copied)] = True
        to = np.append(np.full(len(own_doc), shard.number % self.bins), (gram[i] % U(self.bins)).astype(np.int64))
        return _table(
            _PASSAGE,
            to.astype(np.int32),
            own,
            np.full(n, shard.number, dtype=np.int32),
            shard.seq[of],
            shard.rank[of],
            np.append(own_start, start[i]),
            np.append(own_n, (last - start)[i] + self.size),
            np.append(more, offset[i]).astype(np.int32),
            np.append(more.astype(bool), copies),
            np.append(more, gram[i].view(np.int64)),
            [None] * len(own_doc) + texts,
        )

    def _selected(self, shard: _Shard, known: pa.Table) -> list[np.ndarray]:
        """Passages (piece, first and last window in the piece, offset of the anchor, key) whose anchor may occur again."""
        gram, split = known.column("gram").to_numpy().view(np.uint64), known.column("split").to_numpy()
        whole, hot, windows = (np.sort(gram[split == kind]) for kind in (WHOLE, SPLIT, WINDOW))
        parts: list[list[np.ndarray]] = []
        n_pieces = 0
        for chunk in self._chunks(shard):
            a = rolling.anchors(chunk.prefix, chunk.starts, chunk.ends, self.size, self.gram)
            base, many = chunk.starts, _among(a.gram, hot)
            one = ~many
            parts.append([a.doc[one] + n_pieces, (a.first - base[a.doc])[one], (a.last - base[a.doc])[one], (a.at - a.first)[one], a.gram[one], _among(a.gram[one], whole)])
            rows = np.flatnonzero(many)
            start, of = rolling.spread(a.first[rows], a.last[rows])
            if len(start):
                doc, key = a.doc[rows][of], self._window_keys(chunk, start)
                parts.append([doc + n_pieces, start - base[doc], start - base[doc], a.at[rows][of] - start, key, _among(key, windows)])
            n_pieces += len(chunk.doc)
        if not parts:
            return [np.empty(0, dtype=np.int64)] * 4 + [np.empty(0, dtype=np.uint64)]
        piece, first, last, offset, key, elsewhere = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(elsewhere | (count[inverse] > 1))
        keep = keep[np.lexsort((first[keep], piece[keep]))]
        return [x[keep] for x in (piece, first, last, offset, key)]

    # 6. block: which windows of its passages occur again
    def settle(self, table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        names = [f.split()[0] for f in _RANGE.split(", ")]
        out = table.filter(pa.array(own)).select(names)
        table = table.filter(pa.array(~own))
        if not table.num_rows:
            return out
        shard, seq, start = _numbers(table, "shard", "seq", "start")
        record, begin, n = self.decide(table, self.size)
        found = _table(_RANGE, shard[record], seq[record], start[record] + begin, n)
        return pa.concat_tables([out, found])

    # 7. shard: ranges of each document
    def conclude(self, docs: pa.Table, ranges: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _columns([], [])
        shard = _Shard(docs)
        seq, start, n = _numbers(ranges, "seq", "start", "n")
        order = np.argsort(seq, kind="stable")
        seq, start, end = seq[order], start[order], (start + n)[order]
        x, y = np.searchsorted(seq, shard.seq), np.searchsorted(seq, shard.seq, side="right")
        found = [rolling.merged(start[i:j], end[i:j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        return self.finish(shard.ids, shard.texts, found)


# --- the two ways to decide


def _ranges(out: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([r[i] for r in out], dtype=np.int64) for i in range(3))


def factored(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (row, start, length), in words, that earlier passages of the block hold.

    Passages that share a key are taken in the order of documents and factored
    against the reference text that those before them made; what is new in one
    is added to the reference.
    """
    gram, rank, seq, start = _numbers(table, "gram", "rank", "seq", "start")
    texts = table.column("text").to_pylist()
    order = np.lexsort((start, seq, rank, gram))
    head = np.flatnonzero(np.append(True, gram[order[1:]] != gram[order[:-1]]))
    out: list[tuple[int, int, int]] = []
    for x, y in zip(head.tolist(), np.append(head[1:], len(order)).tolist(), strict=True):
        if y - x == 1:
            continue
        reference, whole = Reference(size), {}
        rows = order[x:y].tolist()
        alike = len({texts[i] for i in rows}) == 1
        for i in rows:
            text = texts[i]
            n = whole.get(text)
            if n is not None:
                out.append((i, 0, n))
                continue
            words = text.split(b" ")
            whole[text] = len(words)
            if not alike:
                out += [(i, s, e - s) for s, e in reference.spans(words)]
                reference.add(words)
    return _ranges(out)


def suffix_sorted(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (row, start, length), in bytes, of windows that occur again in the block.

    The suffixes at the starts of passages are sorted; passages that agree to
    their end are copies as wholes. Of those that differ but share a key, the
    suffixes at every window are sorted, and windows that agree are copies.
    """
    n, offset, copies, gram = _numbers(table, "n", "offset", "copies", "gram") if table.num_rows else [np.empty(0)] * 4
    texts = table.column("text").combine_chunks()
    longest = int(n.max())
    symbols = np.frombuffer(b"".join(texts.to_pylist()) + bytes(longest), dtype=np.uint8)
    start = np.cumsum(n) - n
    prefix = Prefix(rolling.BYTE_VALUES[symbols])
    # passages
    key = gram.view(np.uint64)
    group = rolling.mix(key + offset.astype(np.uint64) * U(0x9E3779B97F4A7C15) + n.astype(np.uint64) * U(0xA24BAED4963EE407))
    order, ext = rolling.verified_order(prefix, symbols, start, group, longest)
    same = np.append(False, (ext >= n[order])[1:] & (n[order[1:]] == n[order[:-1]]) & (group[order[1:]] == group[order[:-1]]))
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(~same) - 1
    times = np.bincount(of) + (np.bincount(of, weights=copies) > 0)
    whole = times[of] > 1
    record, begin, length = [np.flatnonzero(whole)], [np.zeros(int(whole.sum()), dtype=np.int64)], [n[whole]]
    # windows of one passage of each kind, where a key has several kinds
    one = order[~same]
    by = np.argsort(key[one], kind="stable")
    k = key[one][by]
    lone = np.append(True, k[1:] != k[:-1]) & np.append(k[1:] != k[:-1], True)
    one = np.sort(one[by[~lone]])
    if len(one):
        step, which = rolling.spread(np.zeros(len(one), dtype=np.int64), n[one] - size)
        row = one[which]
        order, ext = rolling.verified_order(prefix, symbols, start[row] + step, rolling.mix(key[row] + (offset[row] - step).view(np.uint64) * U(0x9E3779B97F4A7C15)), size)
        equal = ext >= size
        hit = np.zeros(len(row), dtype=bool)
        hit[order] = equal | np.append(equal[1:], False)
        hit &= ~whole[row]
        at = np.flatnonzero(hit)
        record.append(row[at])
        begin.append(step[at])
        length.append(np.full(len(at), size))
    record, begin, length = (np.concatenate(x) for x in (record, begin, length))
    # ranges of a passage that touch become one
    at, end = rolling.merged(begin + (record << 32), begin + length + (record << 32))
    return at >> 32, at & 0xFFFFFFFF, end - at


# --- results


def _columns(ids: list, rows: list[tuple]) -> pa.Table:
    n_all, n_removed, n_spans, digest, starts, ends = zip(*rows, strict=True) if rows else [()] * 6
    return pa.table(
        {
            "doc_id": pa.array(ids, type=pa.int64()),
            "n": pa.array(n_all, type=pa.int64()),
            "n_removed": pa.array(n_removed, type=pa.int64()),
            "n_spans": pa.array(n_spans, type=pa.int64()),
            "kept_sha256": pa.array(digest, type=pa.string()),
            "starts": pa.array(starts, type=pa.list_(pa.int64())),
            "ends": pa.array(ends, type=pa.list_(pa.int64())),
        }
    )


def _finish_bytes(ids: list, texts: list[bytes], spans: list) -> pa.Table:
    rows = []
    for text, (start, end) in zip(texts, spans, strict=True):
        kept = b"".join([text[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)]) if len(start) else text
        rows.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), start, end))
    return _columns(ids, rows)


def _finish_words(ids: list, texts: list[bytes], spans: list) -> pa.Table:
    rows = []
    for text, (start, end) in zip(texts, spans, strict=True):
        words = text.split()
        kept = [w for x, y in zip([0, *end.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[x:y]] if len(start) else words
        rows.append((len(words), len(words) - len(kept), len(start), hashlib.sha256(b" ".join(kept)).hexdigest(), start, end))
    return _columns(ids, rows)


def _tidy(step: Callable) -> Callable:
    """`step` as a plain function (Spark would count a method's `self` as a key) that gives memory back."""

    def run(table: pa.Table) -> pa.Table:
        out = step(table)
        release_memory()
        return out

    return run


def _tidy_two(step: Callable) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(left, right)
        release_memory()
        return out

    return run


def _run(df: DataFrame, id_col: str, text_col: str, words: bool, size: int, gram: int, first_stays: bool, decide: Callable, finish: Callable, shard_bytes: int) -> DataFrame:
    if not 1 <= gram <= size:
        raise ValueError("an anchor has 1 to `window` symbols")
    docs = keyed_text(df, id_col, text_col)
    shards = shard_count(df.sparkSession, text_bytes(docs, "text"), shard_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("seq"))
    by_shard = docs.select(F.pmod(F.xxhash64("doc_id", "seq"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "seq", "text").groupBy("shard")
    plan = Plan(words, size, gram, first_stays, shards, decide, finish, VARIANTS, UNSPLIT, CHUNK_BYTES)
    known = stored(by_shard.applyInArrow(_tidy(plan.announce), _ANCHOR).groupBy("bin").applyInArrow(_tidy(plan.judge), _KNOWN), "anchors")
    windows = by_shard.cogroup(known.where(F.col("split") == SPLIT).groupBy("shard")).applyInArrow(_tidy_two(plan.announce_windows), _WINDOWS)
    known = known.unionByName(windows.groupBy("bin").applyInArrow(_tidy(plan.judge_windows), _KNOWN))
    passages = by_shard.cogroup(known.groupBy("shard")).applyInArrow(_tidy_two(plan.compare), _PASSAGE)
    ranges = passages.groupBy("bin").applyInArrow(_tidy(plan.settle), _RANGE)
    return by_shard.cogroup(ranges.groupBy("shard")).applyInArrow(_tidy_two(plan.conclude), _RESULT)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, phrase: int = 8, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Word windows that occur earlier in the corpus, by relative Lempel-Ziv factors.

    Every passage whose anchor (`phrase` words) occurs again is sent to the
    reference block of that anchor. A block takes its passages in the order of
    documents and parses each greedily against its indexed reference text, the
    passages before; factors have at least `window` words, and phrases across
    their boundaries are looked up too. Ranges from all blocks are united.

    A word is a run of bytes other than white space 0x20 and 0x09-0x0D. A word
    goes if a window that covers it occurs earlier, by (doc_id, start). Returns
    doc_id, n (words), n_removed, n_spans, kept_sha256 of the kept words joined
    by one space, and starts and ends of the spans in words. See the module for
    nulls and ties.
    """
    return _run(df, id_col, text_col, True, window, phrase, True, factored, _finish_words, shard_bytes)


def suffix_array_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 56, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes every byte of a `window`-byte string that starts more than once in the corpus.

    Passages whose anchor (`gram` bytes) occurs again meet in a block, which
    sorts their suffixes by a mergesort that compares by prefix hashes: a binary
    search finds the common extension. Every pair of neighbours in the sorted
    order is then compared byte for byte.

    Returns doc_id, n (bytes), n_removed, n_spans (maximal removed runs),
    kept_sha256 of the kept bytes, and starts and ends of the spans in bytes.
    See the module for nulls and ties.
    """
    return _run(df, id_col, text_col, False, window, gram, False, suffix_sorted, _finish_bytes, shard_bytes)


def apply_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """`text` without the given byte spans."""
    return b"".join(text[x:y] for x, y in zip([0, *ends], [*starts, len(text)], strict=True))
