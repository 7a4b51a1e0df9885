"""Vectorised polynomial hashes, content-chosen anchors and a hash-compared suffix sort.

A sequence of symbols (bytes or words) is given as an array of 64-bit values a
symbol. `Prefix` holds prefix sums of symbol * BASE**i modulo 2**64, from which
the hash of any range follows. These hashes say where to look and in which
order; sequences that they call equal are compared by their symbols.

`anchors` picks, for every window of `size` symbols, the k-gram of least hash
in it (leftmost among equals). Equal windows pick equal k-grams at equal
offsets, so that only windows of one anchor hash can be equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_POS_BITS = 24
_BLOCK = 1 << 22


BYTE_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits both depend on all bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class _Powers:
    """BASE**i and BASE**-i, grown when a longer text comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers(BASE)


class Prefix:
    """Prefix hashes of symbol values: the hash of [start, end) in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = _POWERS.get(len(values) + 1)
        self.sums = np.empty(len(values) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


@dataclass
class Anchors:
    """Chosen anchors, each with the inclusive range of window starts that chose it."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    gram: np.ndarray  # hash of the k-gram


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the least value among the next `width`, leftmost on ties."""
    n = len(values) - width + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for s in range(0, n, _BLOCK):
        e = min(n, s + _BLOCK)
        part = values[s : e + width - 1] & ~U((1 << _POS_BITS) - 1)
        part |= np.arange(len(part), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            part = np.minimum(part[:-step], part[step:])
            step *= 2
        if step < width:
            part = np.minimum(part[: e - s], part[width - step : width - step + e - s])
        out[s:e] = (part[: e - s] & U((1 << _POS_BITS) - 1)).astype(np.int64) + s
    return out


def anchors(p: Prefix, starts: np.ndarray, ends: np.ndarray, size: int, k: int) -> Anchors:
    """Anchors of all windows of `size` symbols that lie inside one document.

    starts, ends: the documents' ranges, in order, without gaps.
    """
    width = size - k + 1
    long = np.flatnonzero(ends - starts >= size)
    n_windows = (ends - starts - size + 1)[long]
    if not len(long):
        none = np.empty(0, dtype=np.int64)
        return Anchors(none, none, none, none, np.empty(0, dtype=np.uint64))
    least = _least(mix(p.grams(k)), width)
    # the window starts inside documents, one after the other
    before = np.cumsum(n_windows) - n_windows
    start = np.arange(int(n_windows.sum()), dtype=np.int64) + np.repeat(starts[long] - before, n_windows)
    a = least[start]
    new = np.empty(len(start), dtype=bool)
    new[0] = True
    new[1:] = a[1:] != a[:-1]
    new[before] = True
    i = np.flatnonzero(new)
    at, first = a[i], start[i]
    last = np.append(start[i[1:] - 1], start[-1])
    return Anchors(at, first, last, long[np.searchsorted(before, i, side="right") - 1], mix(p.ranges(at, at + k)))


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the inclusive ranges, and of which range each one is."""
    n = last - first + 1
    if not len(n):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def common(p: Prefix, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of suffixes x and y, at most `limit`: a binary search on hashes."""
    low = np.zeros(len(x), dtype=np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        ok = low + step <= limit
        to = np.where(ok, low + step, low)
        same = ok & (p.ranges(x, x + to) == p.ranges(y, y + to))
        low = np.where(same, to, low)
        step >>= 1
    return low


def suffix_order(p: Prefix, values: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by (group, first `limit` symbols, start), and each one's common extension with the one before.

    A bottom-up mergesort over runs of each group: an element's place in the
    merged run is its place in its own run plus the number of elements of the
    sibling run before it, found by binary search. Two suffixes are compared by
    their common extension, then by the first symbol that differs. All groups
    are merged at once. Every suffix must have `limit` symbols.
    """
    n = len(start)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.lexsort((start, group))
    g = group[order]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    length = np.diff(np.append(head, n))
    # groups of one are in place
    many = length > 1
    of = np.repeat(np.arange(len(head)), length)
    live = np.flatnonzero(many[of])
    base, size = head[of], length[of]
    run = 1
    most = int(length.max())
    while run < most:
        live = live[size[live] > run]
        off = live - base[live]
        mine = off // run
        sibling = (mine ^ 1) * run
        lo = base[live] + np.minimum(sibling, size[live])
        hi = base[live] + np.minimum(sibling + run, size[live])
        begin, odd = lo.copy(), (mine & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = start[order[live[open_]]], start[order[mid]]
            ext = common(p, x, y, limit)
            tie = ext == limit
            at = np.minimum(ext, limit - 1)
            u, v = values[x + at], values[y + at]
            # the sibling's element goes first if it is less; on a tie the left run goes first, which keeps starts ascending
            less = np.where(tie, odd[open_], v < u)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        to = base[live] + (mine >> 1) * 2 * run + (off - mine * run) + (lo - begin)
        moved = order[live]
        order = order.copy()
        order[to] = moved
        run *= 2
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        lcp[same] = common(p, start[order[same - 1]], start[order[same]], limit)
    return order, lcp


def verified_order(p: Prefix, symbols: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """`suffix_order`, proved: each neighbour pair is compared symbol by symbol.

    Returns the order and each suffix's true common extension with the one
    before (0 at a group's start). If all neighbours stand in the right order,
    so does the whole; a group where hashes misled the sort is sorted again by
    its symbols.
    """
    order, claimed = suffix_order(p, symbols, start, group, limit)
    ext = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return order, ext
    same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    rows = np.lib.stride_tricks.sliding_window_view(symbols, limit)
    wrong = []
    for i in np.array_split(same, max(1, len(same) >> 14)):
        x, y = start[order[i - 1]], start[order[i]]
        ext[i] = _true_extension(rows[x], rows[y])
        at = np.minimum(ext[i], limit - 1)
        bad = (ext[i] != claimed[i]) | ((ext[i] < limit) & (symbols[x + at] >= symbols[y + at]))
        wrong.append(group[order[i[bad]]])
    for g in np.unique(np.concatenate(wrong)):
        at = np.flatnonzero(group[order] == g)
        right = sorted(order[at].tolist(), key=lambda k: (rows[start[k]].tobytes(), start[k]))
        order[at] = right
        x, y = start[order[at[:-1]]], start[order[at[1:]]]
        ext[at[1:]] = _true_extension(rows[x], rows[y])
    return order, ext


def _true_extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, how many symbols agree before the first that differs."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ascending disjoint ranges that do not touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    i = np.flatnonzero(new)
    return start[i], end[np.append(i[1:] - 1, len(end) - 1)]
