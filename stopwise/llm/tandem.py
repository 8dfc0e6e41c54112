"""Periodic runs of words: tandem repeats by LZ blocks and a suffix tree.

A run is a stretch of words with smallest period q, at least ``LEAST_POWER``
times as long and ``least`` words long, that no neighbouring word extends.

Each task cuts its texts down to stretches that can hold a run: every five words
in a row within a run recur in it (a run is six words or more, and four periods),
so words outside such recurring fives, and stretches whose fives do not recur in
the stretch itself, cannot belong to one.  The stretches of a chunk of texts are
laid one after another, with a separator of its own after each, and ``Repeats``
finds their tandem repeats in three phases:

1. The Lempel-Ziv blocks of the word sequence: each tandem repeat's leftmost
   occurrence has its centre in a block and crosses one of its borders, so
   extensions from the borders, forwards and backwards, give a set of squares
   that covers them all.
2. The squares are marked in the suffix tree, and from each mark suffix links
   lead to the square that is one word further, as long as the tree continues
   with the word left behind and the place is not marked: the marks are then
   all kinds of squares.
3. The leaves below the marks of primitive squares are all their occurrences;
   those that follow one another with one period merge into a run.

Equality of stretches is decided by classes of 1, 2, 4 ... words, without hashes
of longer stretches; words are equal if their 64-bit hashes are.

Defined cases: null and empty texts have no words and no runs; rows with a null id
are searched and keep it; repeated rows are searched each on its own; an empty
table gives an empty table; further columns are dropped; texts are taken whole,
and memory grows with the longest text's recurring stretches (about 1 KB a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, buffers, mix, windows, words

LEAST_POWER = 4
LEAST_WORDS = 6
#: Words in a row that recur within every run of LEAST_WORDS words and LEAST_POWER periods.
GRAM = 5
#: Times that stretches are cut down at most; further cuts would only save work.
CUTS = 4


class Classes:
    """Classes of equal stretches of 1, 2, 4 ... symbols, and the suffix array; the last symbol must be unique."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
        self.rank, self.n = [rank], n
        order = np.argsort(rank, kind="stable")
        while int(rank.max()) < n - 1:
            size = 1 << (len(self.rank) - 1)
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1 if size < n else 0
            key = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            self.rank.append(rank)
        self.order = order

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequences that begin at a and b (different places) agree."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            x, y, rank = a + out, b + out, self.rank[k]
            inside = np.maximum(x, y) + (1 << k) <= self.n
            same = inside.copy()
            same[inside] = rank[x[inside]] == rank[y[inside]]
            out += same.astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequences that end before a and b agree."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            x, y, rank = a - out - (1 << k), b - out - (1 << k), self.rank[k]
            inside = np.minimum(x, y) >= 0
            same = inside.copy()
            same[inside] = rank[x[inside]] == rank[y[inside]]
            out += same.astype(np.int64) << k
        return out


def blocks(c: Classes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end: each is the longest stretch that occurs at an earlier place too, or one symbol."""
    n, order = c.n, c.order
    before, after = np.full(n + 1, n), np.full(n + 1, n)
    before[order[1:]], after[order[:-1]] = order[:-1], order[1:]
    before, after = before.tolist(), after.tolist()
    for i in range(n - 1, -1, -1):  # what is left when i is taken out are its neighbours among earlier places
        a, b = before[i], after[i]
        after[a], before[b] = b, a
    at, longest = np.arange(n), np.zeros(n, np.int64)
    for other in (np.array(before[:n]), np.array(after[:n])):
        own = np.flatnonzero(other < n)
        longest[own] = np.maximum(longest[own], c.forward(at[own], other[own]))
    starts, i, longest = [], 0, longest.tolist()
    while i < n:
        starts.append(i)
        i += max(1, longest[i])
    return np.array([*starts, n])


def covering_squares(c: Classes, longest_period: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares across block borders, whose suffix-link walks reach every kind of square of a period up to the longest."""
    at, symbol = blocks(c), c.rank[0]
    begin, end = at[:-1], at[1:]
    size = end - begin
    found = []
    # centre in the block, right half beyond its end; then left half before its begin
    for border, most, sign in ((end, size, -1), (begin, size + np.append(size[1:], 0), 1)):
        most = np.minimum(most, longest_period)
        which = np.repeat(np.arange(len(border)), most)
        k = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1
        h = border[which]
        other = h + sign * k
        good = (h < c.n) & (other >= 0) & (other < c.n)
        h, k, other = h[good], k[good], other[good]
        good = symbol[h] == symbol[other]
        h, k, other = h[good], k[good], other[good]
        on, back = c.forward(h, other), c.backward(h, other)
        left = np.minimum(h, other)
        good = on + back >= k
        found.append((np.maximum(left - back, left - k + 1)[good], k[good]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(start * (c.n + 1) + period)
    return pairs // (c.n + 1), pairs % (c.n + 1)


class SuffixTree:
    """Nodes 0..n-1 are the leaves by their suffix, n is the root, further numbers inner nodes."""

    def __init__(self, c: Classes) -> None:
        n, order = c.n, c.order
        common = c.forward(order[:-1], order[1:]).tolist()
        order_list = order.tolist()
        depth = list(range(n, 0, -1)) + [0]
        parent, low, high = [n] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        stack = [n]
        for r in range(1, n + 1):
            level, child = common[r - 1] if r < n else 0, order_list[r - 1]
            low[child] = high[child] = r - 1
            while depth[stack[-1]] > level:
                top = stack.pop()
                parent[child], high[top], child = top, r - 1, top
            if depth[stack[-1]] < level:
                stack.append(len(depth))
                depth.append(level)
                parent.append(n)
                low.append(low[child])
                high.append(0)
            parent[child] = stack[-1]
        high[n] = n - 1
        self.depth, self.parent, self.low, self.high, self.root = depth, parent, low, high, n
        self.symbol = c.rank[0].tolist()
        self.width = int(c.rank[0].max()) + 1
        self.witness = order[np.array(low)].tolist()
        up, edge = np.array(parent), np.array(self.witness)
        keys = up * self.width + c.rank[0][np.minimum(edge + np.array(depth)[up], n - 1)]
        self.child = {k: v for v, k in enumerate(keys.tolist()) if v != n}
        self.link = [n] * len(depth)
        inner = np.arange(n + 1, len(depth))
        for v in inner[np.argsort(np.array(depth)[n + 1 :], kind="stable")].tolist():
            self.link[v] = self.down(self.link[parent[v]] if parent[v] != n else n, self.witness[v] + 1, depth[v] - 1)

    def down(self, node: int, at: int, to: int) -> int:
        """From a node on the way of suffix at, the first node on that way of depth ``to`` or more."""
        depth, symbol, child, width = self.depth, self.symbol, self.child, self.width
        while depth[node] < to:
            node = child[node * width + symbol[at + depth[node]]]
        return node


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of all kinds of squares: those at the given places and all that suffix-link walks reach from them."""
    depth, parent, symbol, witness, link, child, width = tree.depth, tree.parent, tree.symbol, tree.witness, tree.link, tree.child, tree.width
    order = np.lexsort((-period, start))
    marks, last, node, unit = [], -1, 0, len(symbol) + 1
    for i, q in zip(start[order].tolist(), period[order].tolist(), strict=True):
        if i != last:
            node, last = i, i
        while depth[parent[node]] >= 2 * q:  # longer ones first, so the way up is gone once
            node = parent[node]
        marks.append(node * unit + q)
    known = set(marks)
    for mark in list(known):
        node, q = divmod(mark, unit)
        d = 2 * q
        while True:
            at = witness[node]
            node = tree.down(link[parent[node]], at + 1, d - 1)
            if depth[node] == d - 1:
                node = child.get(node * width + symbol[at], -1)
                if node < 0:
                    break
            elif symbol[witness[node] + d - 1] != symbol[at]:
                break
            mark = node * unit + q
            if mark in known:
                break
            known.add(mark)
    all_ = np.fromiter(known, np.int64, len(known))
    return all_ // unit, all_ % unit


def _primitive(c: Classes, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares have a root that is no power itself."""
    least = np.arange(int(period.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            multiples = np.arange(p * p, len(least), p)
            least[multiples] = np.minimum(least[multiples], p)
    good, rest = np.ones(len(at), bool), period.copy()
    while (todo := np.flatnonzero(rest > 1)).size:
        prime = least[rest[todo]]
        part = period[todo] // prime
        good[todo] &= c.forward(at[todo], at[todo] + part) < 2 * period[todo] - part
        rest[todo] //= prime
    return good


def runs(symbols: np.ndarray, longest_period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal stretches of two periods or more, by period and start; the last symbol must be unique."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2 or longest_period < 1:
        return none, none, none
    c = Classes(symbols)
    start, period = covering_squares(c, longest_period)
    if not len(start):
        return none, none, none
    tree = SuffixTree(c)
    node, period = vocabulary(tree, start, period)
    low, high = np.array(tree.low)[node], np.array(tree.high)[node]
    good = _primitive(c, c.order[low], period)
    low, high, period = low[good], high[good], period[good]
    times = high - low + 1
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    at, period = c.order[place], np.repeat(period, times)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], at[last] - at[first] + 2 * period[first], period[first]


def _stretches(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of stretches of one text that can hold runs."""
    at, hashes = windows(w, GRAM)
    group = w.row[at].astype(np.uint64)
    lo = hi = np.zeros(0, np.int64)
    for _ in range(CUTS):
        key = mix(hashes + mix(group))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        before = len(at)
        at, hashes = at[again], hashes[again]
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(at)]]))
        long = size >= LEAST_WORDS - GRAM + 1
        lo, hi = at[first[long]], at[first[long]] + size[long] + GRAM - 1
        keep = np.repeat(long, size)
        at, hashes, group = at[keep], hashes[keep], np.repeat(np.arange(int(long.sum())), size[long]).astype(np.uint64)
        if len(at) == before:
            break
    return lo, hi


def word_runs(w: Words, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of all texts of a chunk, by first word and period."""
    lo, hi = _stretches(w)
    none = np.zeros(0, np.int64)
    if not len(lo):
        return none, none, none
    size = hi - lo
    base = np.cumsum(size + 1) - size - 1
    word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    symbols = np.zeros(int(size.sum()) + len(lo), np.int64)
    separator = base + size
    inside = np.ones(len(symbols), bool)
    inside[separator] = False
    codes = np.unique(w.hash[word], return_inverse=True)[1]
    symbols[inside] = codes
    symbols[separator] = len(w.hash) + np.arange(len(lo))
    start, length, period = runs(symbols, int(size.max()) // LEAST_POWER)
    good = length >= np.maximum(least, LEAST_POWER * period)
    start, length, period = start[good], length[good], period[good]
    start = start + (lo - base)[np.searchsorted(base, start, "right") - 1]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs by start and period, and collapsed: the words joined by a space, without those of any run after its first period."""
    if least < LEAST_WORDS:
        raise ValueError(f"runs are of {LEAST_WORDS} words at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for w in words(batch.column(1), lower=False):
                start, length, period = word_runs(w, least)
                dropped = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, start + length, -1)
                gone = np.cumsum(dropped)[:-1] > 0
                rows = w.last - w.first
                cut = np.searchsorted(w.row[start], np.arange(rows + 1)).astype(np.int32)
                touched = set(w.row[start].tolist())
                raw, kept = data[offsets[w.first] : offsets[w.last]].tobytes(), []
                for i in range(rows):
                    a, b = (int(offsets[w.first + j] - offsets[w.first]) for j in (i, i + 1))
                    own = raw[a:b].split()
                    if i in touched:
                        own = [x for x, g in zip(own, gone[w.bounds[i] : w.bounds[i + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(own))
                own = pa.StructArray.from_arrays([pa.array(x) for x in (start - w.bounds[w.row[start]], length, period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, rows), pa.array(np.diff(w.bounds)), pa.ListArray.from_arrays(pa.array(cut), own), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(search, RUNS)
