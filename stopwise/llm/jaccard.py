"""Exact Jaccard join of documents on word shingles, by pivots in a metric space.

The Jaccard distance is a metric, so distances to pivots bound distances between
documents; r = 1 - threshold is the greatest distance of a link.

1. Whole-document pivots cannot divide a corpus at the first level: nearly every
   document is at distance 1 from nearly every other, so every window would hold
   everything.  The first regions are therefore those of single shingles: a
   document lies in the region of each shingle of its prefix, its n - ceil(t n) + 1
   first shingles in a common order, and documents that may link share a region.
   The order is by hash, with shingles that are frequent last, which are counted
   over all documents; it decides the regions' sizes and never the result.
2. Each region has a document as pivot, the same for the regions of one group of
   near copies, and regions of one pivot become one.  Links to the pivot are
   measured; what is linked already needs no further look.
3. Regions of more than ``REGION`` documents recur: several pivots at once make
   Voronoi cells of the documents within ``RADIUS`` of their nearest pivot.  If
   j lies in q's cell, a linked i has d(i, q) <= RADIUS + r and
   d(i, q) <= d(i, its own pivot) + 2 r; all that are in this window are
   replicated to the cell.  Documents near no pivot are a region of their own.
   Regions recur until they are small or pivots no longer divide them.
4. Regions are joined in tasks.  Documents go to blocks of at most ``BLOCK``
   documents, about, and each two blocks of a region meet once.  First the
   prefixes bound each pair; documents with a possible partner meet again with
   their whole sets.  A task returns a spanning forest of the links it finds, so
   no row is made for a pair.

Documents with equal shingle sets are one class throughout, so copies cost
nothing further.

Defined cases: documents without words or text have no shingles and link to
nothing; one of fewer than k words has its whole sequence as a shingle; rows that
repeat an id are a document for each text and keep a row each; rows with a null
id are dropped; an empty table gives an empty table; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bound_batches, column, heaviest, mix, stash, windows, words
from .components import star_components

#: Documents that a frequent shingle is in, at least.
FREQUENT_LEAST = 16
#: Frequent shingles that are broadcast, at most.
FREQUENT = 2_000_000
#: Bytes of text whose shingles are counted in one slice, about, and shingles that a task counts at once.
COUNT_BYTES = 8_000_000
COUNT_TOKENS = 1 << 21
#: Documents of a region that is not divided further.
REGION = 1_024
#: Pivots of a region that is divided, at most, and the radius of their cells.
PIVOTS = 8
RADIUS = 0.5
#: A part of more than this share of its region's documents is not divided further.
STUCK = 0.8
#: Documents and shingles of a block of a region, about.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Ids of at most so many documents are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs of at most so many are broadcast to the sets; more are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Shingles of a slice of the regions, about.
SLICE_TOKENS = 400_000

_ROWS = 1 << 15
#: In prefixes a shingle is 47 bits of its hash; bit 47 is set for frequent ones, so they come last.
_BITS = 47
_TOKEN = np.uint64((1 << _BITS) - 1)
_FREQUENT_BIT = np.uint64(1 << _BITS)
_SLACK = 1e-9


def _sets(texts: pa.Array, k: int, frequent: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For bounded runs of rows: first row, bounds of each row, its distinct shingles as 48-bit numbers, in order, and their whole hashes."""
    sieve = None
    if frequent is not None and len(frequent):
        sieve = np.zeros(1 << 22, bool)
        sieve[frequent & np.uint64((1 << 22) - 1)] = True
    for lo in range(0, len(texts), _ROWS):
        for w in words(texts.slice(lo, _ROWS)):
            at, h = windows(w, k, short=True)
            token = h >> np.uint64(64 - _BITS)
            if sieve is not None:
                maybe = np.flatnonzero(sieve[token & np.uint64((1 << 22) - 1)])
                place = np.minimum(np.searchsorted(frequent, token[maybe]), len(frequent) - 1)
                token[maybe[frequent[place] == token[maybe]]] |= _FREQUENT_BIT
            key = (w.row[at].astype(np.uint64) << np.uint64(48)) | token
            order = np.argsort(key, kind="stable")
            key, h = key[order], h[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])]) if len(key) else np.zeros(0, bool)
            key, h = key[new], h[new]
            bounds = np.searchsorted(key, np.arange(w.last - w.first + 1, dtype=np.uint64) << np.uint64(48))
            yield lo + w.first, bounds, key & np.uint64((1 << 48) - 1), h


def _frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles (47 bits) of FREQUENT_LEAST documents or more, in order; of too many the most frequent ones.

    Every shingle of every document is counted.  Most occur once, so tasks count
    what they hold and send packed arrays, by slices of the hash.
    """
    slices = max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // COUNT_BYTES))

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        part = (token // np.uint64(-(-(1 << _BITS) // slices))).astype(np.int64)
        kinds, first = np.unique(part, return_index=True)
        runs = [(token[a:b], n[a:b]) for a, b in zip(first, np.append(first, len(part))[1:], strict=True)]
        once = [_packed(t[m == 1]) for t, m in runs]
        more = [np.stack([t[m > 1], m[m > 1].astype(np.uint64)], axis=1).tobytes() for t, m in runs]
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, tokens, _ in _sets(batch.column(0), k):
                held.append(tokens)
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield pack(held)
                    held, size = [], 0
        yield pack(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                once, more = _unpacked(x.as_buffer()), np.frombuffer(y.as_buffer(), np.uint64).reshape(-1, 2)
                token += [once, more[:, 0]]
                n += [np.ones(len(once), np.int64), more[:, 1].astype(np.int64)]
        token, n = np.concatenate(token), np.concatenate(n)
        order = np.argsort(token)
        token, n = token[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        often = total >= FREQUENT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(token[first][often].view(np.int64)), pa.array(total[often])], names=["token", "n"])

    parts = docs.select("text").mapInArrow(count, "slice long, once binary, more binary")
    counted = stash(parts.groupBy("slice").applyInArrow(add, "token long, n long"))
    return np.sort(column(heaviest(counted, FREQUENT).select("token")).view(np.uint64))


def _features(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Per row (key, doc_id): number of shingles, two hashes of the set, and the prefix's shingles in order, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, tokens, h in _sets(batch.column(2), k, shared.value):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(s)), dtype=np.uint64)]) for s in (1, 0x5DEECE66D)]
                a, b = bounds[:-1], bounds[1:]
                n = b - a
                prefix = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)), pa.array(n),
                        *[pa.array((s[b] - s[a]).view(np.int64)) for s in sums], pa.array([_packed(tokens[x : x + p]) for x, p in zip(a, prefix, strict=True)], pa.binary()),
                    ],
                    names=["key", "doc_id", "n", "d1", "d2", "prefix"],
                )

    return docs.select("key", "doc_id", "text").mapInArrow(emit, "key long, doc_id long, n long, d1 long, d2 long, prefix binary")


def _regions(heads: DataFrame, total: int) -> DataFrame:
    """(token, node): the documents of each shingle's region, of two or more.

    Most shingles occur once.  They meet as packed arrays, slice by slice of the
    hash; only frequent ones, of which a slice could hold too many, meet as rows.
    """
    slices = max(1, -(-total // SLICE_TOKENS))

    def explode(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [_unpacked(x.as_buffer()) for x in batch.column(1)]
        token = np.concatenate([np.zeros(0, np.uint64), *parts])
        node = np.repeat(np.asarray(batch.column(0), np.int64), [len(x) for x in parts])
        return token & _TOKEN, node, (token & _FREQUENT_BIT) != 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node, often = explode(batch)
            token, node = token[~often], node[~often]
            part = (token % np.uint64(slices)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            token, node, part = token[order], node[order], part[order]
            kinds, first = np.unique(part, return_index=True)
            ends = np.append(first, len(part))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (token, node)]], names=["slice", "tokens", "nodes"])

    def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(c1, c2) for batch in batches for c1, c2 in zip(batch.column(1), batch.column(2), strict=True)]
        token, node = (np.concatenate([np.frombuffer(c[i].as_buffer(), kind) for c in columns]) for i, kind in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(token)
        token, node = token[order], node[order]
        same = token[1:] == token[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(node[keep])], names=["token", "node"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node, often = explode(batch)
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(node[often])], names=["token", "node"])

    plain = heads.select("node", "prefix")
    rare = plain.mapInArrow(pack, "slice long, tokens binary, nodes binary").groupBy("slice").applyInArrow(shared_tokens, "token long, node long")
    return rare.unionByName(plain.mapInArrow(loose, "token long, node long"))


def _texts_of(docs: DataFrame, keys: DataFrame, few: bool) -> DataFrame:
    """Rows of docs whose key is in keys (one column, key; repeated ones if few, which are broadcast)."""
    if not few:
        keys = keys.distinct()
        few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def _packed(tokens: np.ndarray) -> bytes:
    """Numbers of 6 bytes."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(packed) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Sets(NamedTuple):
    """Shingle sets of the documents (key, text), made from the texts each time they are asked for."""

    docs: DataFrame
    k: int
    repeated: bool  # keys may repeat

    def of(self, nodes: DataFrame, few: bool) -> DataFrame:
        """(node, tokens) of the nodes (one column; few: with repeats, few enough to broadcast): whole hashes of 8 bytes, sorted."""
        k = self.k

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, bounds, _, h in _sets(batch.column(1), k):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(bounds) - 1), pa.array([np.sort(h[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                        names=["node", "tokens"],
                    )

        out = _texts_of(self.docs, nodes.toDF("key"), few).select("key", "text").mapInArrow(emit, "node long, tokens binary")
        return out.dropDuplicates(["node"]) if self.repeated else out


def _met(pairs: DataFrame, sets: Callable[[DataFrame, bool], DataFrame], look: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """look over batches of pairs (a, b, further columns) with the bytes of both sides as columns ta and tb at the end; sets(nodes, few) gives (node, tokens)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(look, batches)

    pairs = stash(pairs)
    small = pairs.count() <= BROADCAST_PAIRS
    left = sets(pairs.select("a"), small).select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets(pairs.select("b"), small).select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return right.join(F.broadcast(pairs) if small else pairs, "b").join(left, "a").select(*pairs.columns, "ta", "tb").mapInArrow(each, schema)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _measured(pairs: DataFrame, sets: Sets) -> DataFrame:
    """(a, b, common, together): sizes of intersection and union of each pair's sets."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [[np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in ("ta", "tb")]
        common = [_shared(x, y) for x, y in zip(*sides, strict=True)]
        together = [len(x) + len(y) - c for x, y, c in zip(*sides, common, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(together, pa.int64())], names=["a", "b", "common", "together"])

    return _met(pairs.select("a", "b"), sets.of, measure, "a long, b long, common long, together long")


def most_common(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """The most shingles that two sets of nx and ny can share, from their prefixes in the common order.

    What both have up to the end of the prefix that ends first is in both
    prefixes; of the rest each side has only so many.
    """
    if not len(x) or not len(y):
        return 0
    if x[-1] > y[-1]:
        x, y, nx, ny = y, x, ny, nx
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return same + min(nx - len(x), ny - int(np.searchsorted(y, x[-1], "right")))


def _prefixes(heads: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    return lambda nodes, few: heads.select("node", F.col("prefix").alias("tokens")).join(F.broadcast(nodes.toDF("node")) if few else nodes.toDF("node").distinct(), "node", "left_semi")


def _possible(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb: sizes of their sets) that can link by their prefixes, a small part of the sets."""

    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for nx, ny, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
            most = most_common(_unpacked(x.as_buffer()), _unpacked(y.as_buffer()), nx, ny)
            good.append(den * most >= num * (nx + ny - most))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _met(pairs, _prefixes(heads), bound, "a long, b long")


def _labelled(cells: DataFrame, part: DataFrame) -> DataFrame:
    """cells (cell, node, n) with each node's component so far, without cells of one component."""
    known = cells.join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = known.groupBy("cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("cell")
    return known.join(mixed, "cell", "left_semi")


def _divided(cells: DataFrame, sets: Sets, num: int, den: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells with their windows, (cell, node, n, whole: documents of the region divided), and measured distances to pivots (a, b, common, together)."""
    reach = (den - num) / den
    whole = cells.groupBy("cell").agg(F.count("*").alias("whole"))
    sized = cells.join(whole, "cell")
    h = F.xxhash64("node", "cell", F.lit(turn))
    # about 4 PIVOTS candidates of each region; no task sorts a region
    drawn = sized.where(F.pmod(h, F.col("whole")) < 4 * PIVOTS).withColumn("_rank", F.row_number().over(W.partitionBy("cell").orderBy(h, "node"))).where(F.col("_rank") <= PIVOTS)
    pivots = stash(drawn.select("cell", F.col("node").alias("pivot"), F.col("n").alias("pivot_n")))
    least = 1 - RADIUS - reach  # the similarity at a window's edge
    near = F.least("n", "pivot_n") >= least * F.greatest("n", "pivot_n")
    met = stash(sized.join(pivots, "cell").where(near).select("cell", "node", "n", "whole", "pivot"))
    measured = stash(_measured(met.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), sets))
    far = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(1 - F.col("common") / F.col("together"))
    away = stash(met.join(measured.withColumnsRenamed({"a": "pivot", "b": "node"}), ["pivot", "node"], "left").select("cell", "node", "n", "whole", "pivot", far.alias("d")))
    own = away.groupBy("cell", "node").agg(F.min("d").alias("own"))
    in_window = F.col("d") <= F.least(F.lit(RADIUS + reach), F.col("own") + 2 * reach) + _SLACK
    voronoi = away.join(own, ["cell", "node"]).where(in_window).select(F.xxhash64("cell", "pivot", F.lit(turn)).alias("cell"), "node", "n", "whole")
    outside = sized.join(own.where(F.col("own") <= RADIUS), ["cell", "node"], "left_anti").select(F.xxhash64("cell", F.lit("outside"), F.lit(turn)).alias("cell"), "node", "n", "whole")
    return stash(voronoi.unionByName(outside)), measured


def _recurred(cells: DataFrame, sets: Sets, num: int, den: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Regions (cell, node, n) of at most REGION documents, or that pivots do not divide, and the distances measured on the way."""
    done, known, turn = [], [], 0
    work = cells.withColumn("whole", F.lit(None).cast("long"))
    while True:
        size = work.groupBy("cell").agg(F.count("*").alias("m"), F.max("whole").alias("_whole"))
        open_ = stash(size.where((F.col("m") > REGION) & (F.col("_whole").isNull() | (F.col("m") <= STUCK * F.col("_whole")))).select("cell"))
        if open_.isEmpty():
            return [*done, work.select("cell", "node", "n")], known
        done.append(work.join(open_, "cell", "left_anti").select("cell", "node", "n"))
        work, measured = _divided(work.join(open_, "cell", "left_semi").select("cell", "node", "n"), sets, num, den, turn)
        known.append(measured)
        turn += 1


def _in_blocks(cells: DataFrame) -> DataFrame:
    """cells with a column of two block numbers for each meeting of a node's block with another of its cell."""
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = cells.join(cells.groupBy("cell").agg(parts.alias("parts")), "cell")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *cells.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own"
    )


def overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set, in order, the number of values that it shares with every set.

    Only values of several sets are looked up; of those in most sets it is noted
    who lacks them.
    """
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    most = np.flatnonzero((2 * times > m) & (times > 1))
    keep = ((times > 1) & (2 * times <= m))[value]
    has, of = value[keep], owner[keep]
    lack_of, lack = np.nonzero(_absent(value, owner, most, m))
    # postings of values that some have, and of values that some lack
    n_most = len(most)
    key, holder = np.concatenate([has, len(times) + lack]), np.concatenate([of, lack_of])
    order = np.argsort(key, kind="stable")
    key, holder = key[order], holder[order]
    start, end = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
    by = np.argsort(holder, kind="stable")
    cut = np.searchsorted(holder[by], np.arange(m + 1))
    lacks = np.bincount(lack_of, minlength=m)
    for i in range(m):
        own = by[cut[i] : cut[i + 1]]
        for_some, for_most = own[key[own] < len(times)], own[key[own] >= len(times)]
        some, both_lack = (np.bincount(_ranges(holder, start[x], end[x]), minlength=m) for x in (for_some, for_most))
        # of the values most have, both have all but those that one of the two lacks
        yield some + n_most - lacks[i] - lacks + both_lack


def _absent(value: np.ndarray, owner: np.ndarray, most: np.ndarray, m: int) -> np.ndarray:
    out = np.ones((m, len(most)), bool)
    place = np.searchsorted(most, value)
    place = np.minimum(place, max(0, len(most) - 1))
    if len(most):
        own = most[place] == value
        out[owner[own], place[own]] = False
    return out


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """values[start:end] of each pair, one after another."""
    n = end - start
    return values[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())] if len(n) else values[:0]


class _Meeting(NamedTuple):
    """The documents of two blocks: which pairs are to be looked at."""

    node: np.ndarray
    n: np.ndarray
    part: np.ndarray
    own: np.ndarray
    lo: int
    hi: int
    bytes: list

    @classmethod
    def of(cls, key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> _Meeting:
        table = pa.Table.from_batches(list(batches))
        column = lambda c: np.asarray(table.column(c), np.int64)
        return cls(column("node"), column("n"), column("part"), column("own"), key[1].as_py(), key[2].as_py(), [x.as_buffer() for c in table.column("tokens").chunks for x in c])

    def open_pairs(self, i: int, num: int, den: int) -> np.ndarray:
        """Whether i and each document are of different components, may link by their sizes and meet here (in other meetings of one block with itself: no)."""
        fits = den * np.minimum(self.n, self.n[i]) >= num * np.maximum(self.n, self.n[i])
        return fits & (self.part != self.part[i]) & ((self.own != self.own[i]) | (self.lo == self.hi))


def _may_link(cells: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, node, n, part) of the documents that have a possible partner in their cell by the bound of prefixes."""

    def look(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _Meeting.of(key, batches)
        prefixes = [_unpacked(b) for b in x.bytes]
        size, last = np.array([len(p) for p in prefixes], np.int64), np.array([p[-1] for p in prefixes], np.uint64)
        good = np.zeros(len(x.node), bool)
        for i, same in enumerate(overlaps(prefixes)):
            # of the one whose prefix ends first so many come after it
            most = same + np.where(last <= last[i], x.n - size, x.n[i] - size[i])
            ok = x.open_pairs(i, num, den) & (den * most >= num * (x.n + x.n[i] - most))
            good |= ok
            good[i] |= ok.any()
        at = np.flatnonzero(good)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0].as_py(), np.int64)), *[pa.array(c[at]) for c in (x.node, x.n, x.part)]], names=["cell", "node", "n", "part"])

    met = _in_blocks(cells).join(heads.select("node", F.col("prefix").alias("tokens")), "node")
    found = met.groupBy("cell", "lo", "hi").applyInArrow(look, "cell long, node long, n long, part long")
    return stash(found.distinct())


def _joined(cells: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """Links (u, v) between documents of different components of a cell (cell, node, n, part): a spanning forest for each two blocks."""

    def look(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _Meeting.of(key, batches)
        parts, place = np.unique(x.part, return_inverse=True)
        root = np.arange(len(parts))
        u, v = [], []
        for i, same in enumerate(overlaps([np.frombuffer(b, "<u8") for b in x.bytes])):
            linked = np.flatnonzero(x.open_pairs(i, num, den) & (den * same >= num * (x.n + x.n[i] - same)))
            # one link for each component that i now joins
            other, first = np.unique(root[place[linked]], return_index=True)
            for r, j in zip(other, linked[first], strict=True):
                if r != root[place[i]]:
                    root[root == r] = root[place[i]]
                    u.append(x.node[i])
                    v.append(x.node[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    met = _in_blocks(cells).join(sets.of(cells.select("node"), cells.count() <= BROADCAST_IDS), "node")
    return met.groupBy("cell", "lo", "hi").applyInArrow(look, "u long, v long")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * intersection >= num * union of their k-word shingles.

    Also key and component_key: doc_id and component_id, or where ids repeat
    numbers of (id, text) and of its component.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    repeated = not plain.groupBy("doc_id").count().where("count > 1").isEmpty()
    plain = plain.withColumn("key", document_key(F.col("doc_id"), F.col("text")) if repeated else F.col("doc_id"))
    frequent = _frequent_shingles(plain, k)
    features = stash(_features(plain, k, num, den, frequent))
    # equal sets have equal prefixes
    grouped = features.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("key").alias("node"), F.min("doc_id").alias("least"), F.min("prefix").alias("prefix"))
    classes = stash(grouped)
    heads = classes.select("node", "n", "prefix")

    total = features.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 6
    tokens = stash(_regions(heads, total))
    sets = Sets(plain, k, repeated)

    # the pivot has the least hash: the same document for the regions of one group of near copies
    pivots = tokens.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p")).where("m > 1").select("token", "m", F.col("p.node").alias("cell"))
    placed = stash(tokens.join(pivots, "token").groupBy("cell", "node").agg(F.max("m").alias("m")).where("cell <> node").join(heads.select("node", "n"), "node"))
    near = F.expr(f"{den} * common >= {num} * together")
    as_links = lambda measured: measured.where(near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    centred = placed.join(heads.select(F.col("node").alias("cell"), F.col("n").alias("cell_n")), "cell")
    fits = F.expr(f"{den} * least(n, cell_n) >= {num} * greatest(n, cell_n)")
    pairs = centred.where(fits).select(F.col("cell").alias("a"), F.col("node").alias("b"), F.col("cell_n").alias("na"), F.col("n").alias("nb"))
    # links are written before components contract them in tasks: a task so has one Python worker at a time, not two, and an
    # executor keeps the workers that it once had
    stars = star_components(stash(as_links(_measured(_possible(pairs, heads, num, den), sets))))
    part = _parts(stars)

    # a region of two is its pivot and a document, which have been measured
    cells = stash(_labelled(placed.where("m > 2").select("cell", "node", "n"), part).select("cell", "node", "n"))
    done, known = _recurred(cells, sets, num, den)
    if known:
        stars = star_components(reduce(DataFrame.unionByName, [stars, *map(as_links, known)]))
        part = _parts(stars)
    small = stash(_labelled(reduce(DataFrame.unionByName, done), part))
    found = stash(_joined(_may_link(small, heads, num, den), sets, num, den))

    final = _parts(star_components(stars.unionByName(found)))
    whole = classes.drop("prefix").join(final, "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = whole.join(whole.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("d1", "d2", "n", "component_id", F.col("part").alias("component_key"))
    out = features.select("key", "doc_id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", F.coalesce("component_key", "key").alias("component_key"))


def document_key(doc_id: Column, text: Column) -> Column:
    """The key of a row where ids repeat."""
    return F.xxhash64(doc_id, text)


def _parts(stars: DataFrame) -> DataFrame:
    """(node, part) of the nodes that are not the least of their component."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("part"))
