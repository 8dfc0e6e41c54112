"""Benchmark decontamination by winnowing.

Every window of ``gram`` consecutive words has a hash; of each run of
``window - gram + 1`` such hashes the least one (the rightmost of equals) is a
fingerprint.  Two texts that share ``window`` words share a fingerprint, so
fingerprints of documents and items are joined, and each hit is extended to the
windows around it, which are then compared whole.  Items of fewer words than a
window are one window of their own length and are looked up at that length.

The benchmark's windows are broadcast only if they are counted to be at most
``BROADCAST_WINDOWS``; a larger benchmark is joined by shuffles.

Defined cases: null and empty texts have no words and no hits; items without
words match nothing; repeated rows are treated each on its own; an empty
benchmark or table gives no hits or no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_DIGITS, Words, bound_batches, span_hash, stash, windows, words

BROADCAST_WINDOWS = 2_000_000
HITS = "doc_id long, n_words long, n_hit long, items array<string>"
_MAX = np.uint64(2**64 - 1)


def fingerprints(w: Words, window: int, gram: int) -> np.ndarray:
    """Word index of each selected gram."""
    n, run = len(w.row), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    grams = span_hash(w.hash, np.arange(n - gram + 1), np.arange(gram, n + 1))
    view = np.lib.stride_tricks.sliding_window_view(grams, run)
    inside = np.flatnonzero(w.row[: n - window + 1] == w.row[window - 1 :])
    least = run - 1 - view[inside, ::-1].argmin(axis=1)
    return np.unique(inside + least)


def item_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, size, hash) of every window; (item, 0, hash) of every fingerprint's gram comes from item_grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS_DIGITS):
                at, h = windows(w, window, short=True)
                size = np.minimum(w.bounds[w.row[at] + 1] - at, window) if len(at) else at
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.last - w.first).take(pa.array(w.row[at])), pa.array(size, pa.int32()), pa.array(h.view(np.int64))], names=["item", "size", "hash"])

    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull()).mapInArrow(cut, "item string, size int, hash long")


def item_grams(benchmark: DataFrame, window: int, gram: int, text: str = "text") -> DataFrame:
    """Distinct fingerprints of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), LETTERS_DIGITS):
                at = fingerprints(w, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(span_hash(w.hash, at, at + gram)).view(np.int64))], names=["gram"])

    return benchmark.select(F.col(text).alias("text")).mapInArrow(cut, "gram long").distinct()


def _near(at: np.ndarray, w: Words, window: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a gram at one of these places."""
    starts = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
    starts = starts[(starts >= 0) & (starts + window <= len(w.row))]
    return starts[w.row[starts] == w.row[starts + window - 1]]


def _runs(w: Words, size: int) -> np.ndarray:
    at = np.arange(max(0, len(w.row) - size + 1))
    return at[w.row[at] == w.row[at + size - 1]]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, doc_id: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of an item's window), the items that occur, sorted, and the columns of keep."""
    bound_batches(docs.sparkSession)
    cut = stash(item_windows(benchmark, window))
    total = cut.count()
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), kept.alias("kept"))
    find = _hits_broadcast if total <= broadcast_windows else _hits_shuffled
    return find(plain, benchmark, cut, window, gram).select("doc_id", "n_words", "n_hit", "items", *[F.col(f"kept.{c}") for c in keep])


def _hits_broadcast(docs: DataFrame, benchmark: DataFrame, cut: DataFrame, window: int, gram: int) -> DataFrame:
    table = cut.distinct().toPandas()
    names = np.array(sorted(table["item"].unique()), dtype=object)
    number = {x: i for i, x in enumerate(names)}
    by_size = {}
    for size, part in table.groupby("size"):
        h = part["hash"].to_numpy().view(np.uint64)
        item = part["item"].map(number).to_numpy(np.int64)
        order = np.lexsort((item, h))
        by_size[int(size)] = (h[order], item[order])
    grams = np.sort(item_grams(benchmark, window, gram).toPandas()["gram"].to_numpy(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((names, by_size, grams))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_size, grams = shared.value
        sieve = np.zeros(1 << 20, bool)
        sieve[grams & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            for w in words(batch.column(1), LETTERS_DIGITS):
                rows = w.last - w.first
                covered, pairs = np.zeros(len(w.row) + 1, np.int64), []
                for size, (hashes, items) in by_size.items():
                    if size == window:
                        at = fingerprints(w, window, gram)
                        h = span_hash(w.hash, at, at + gram)
                        keep = sieve[h & np.uint64((1 << 20) - 1)]
                        at, h = at[keep], h[keep]
                        starts = _near(at[_member(h, grams)], w, window, gram)
                    else:
                        starts = _runs(w, size)
                    h = span_hash(w.hash, starts, starts + size)
                    good = _member(h, hashes)
                    starts, h = starts[good], h[good]
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + size, -1)
                    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    row = np.repeat(w.row[starts], hi - lo)
                    each = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]) if len(lo) else lo, hi - lo) + np.arange((hi - lo).sum())
                    pairs.append(np.stack([row, items[each.astype(np.int64)]], 1) if len(row) else np.zeros((0, 2), np.int64))
                hit = np.bincount(w.row[np.cumsum(covered[:-1]) > 0], minlength=rows)
                found = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
                ends = np.searchsorted(found[:, 0], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, rows), pa.array(np.diff(w.bounds), pa.int64()), pa.array(hit, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(names[found[:, 1].astype(np.int64)], pa.string())), batch.column(2).slice(w.first, rows)],
                    names=["doc_id", "n_words", "n_hit", "items", "kept"],
                )

    return docs.mapInArrow(find, f"{HITS}, kept {docs.schema['kept'].dataType.simpleString()}")


def _hits_shuffled(docs: DataFrame, benchmark: DataFrame, cut: DataFrame, window: int, gram: int) -> DataFrame:
    """As _hits_broadcast, with joins on hashes; a row is known by its id and text, so repeated rows get equal results."""
    sizes = [r["size"] for r in cut.select("size").distinct().collect()]  # window numbers at most
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS_DIGITS):
                key = batch.column(0).slice(w.first, w.last - w.first)
                for size in sizes:
                    if size == window:
                        at = fingerprints(w, window, gram)
                        h = span_hash(w.hash, at, at + gram)
                        starts = (at[:, None] - np.arange(window - gram + 1)).ravel()
                        grams = np.repeat(h, window - gram + 1)
                        ok = (starts >= 0) & (starts + window <= len(w.row))
                        starts, grams = starts[ok], grams[ok]
                        ok = w.row[starts] == w.row[starts + window - 1]
                        starts, grams = starts[ok], pa.array(grams[ok].view(np.int64))
                    else:
                        starts = _runs(w, size)
                        grams = pa.nulls(len(starts), pa.int64())
                    h = span_hash(w.hash, starts, starts + size)
                    place = starts - w.bounds[w.row[starts]] if len(starts) else starts
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(w.row[starts])), pa.array(place, pa.int32()), pa.array(np.full(len(starts), size), pa.int32()), grams, pa.array(h.view(np.int64))], names=["key", "at", "size", "gram", "hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *[np.diff(w.bounds) for w in words(batch.column(2), LETTERS_DIGITS, hashes=False)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3)], names=["doc_id", "key", "n_words", "kept"])

    emitted = keyed.select("key", "text").mapInArrow(emit, "key long, at int, size int, gram long, hash long")
    near = emitted.where("gram is not null").join(item_grams(benchmark, window, gram), "gram", "left_semi").drop("gram").unionByName(emitted.where("gram is null").drop("gram"))
    found = stash(near.distinct().join(cut.select("size", "hash").distinct(), ["size", "hash"], "left_semi"))
    items = found.select("key", "size", "hash").distinct().join(cut.distinct(), ["size", "hash"]).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    covered = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"))  # at most one span for each word and size
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["size"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("n"))
    counted = covered.select("key", F.aggregate("spans", start, step, lambda acc: acc["n"]).alias("n_hit"))
    base = keyed.select("doc_id", "key", "text", "kept").mapInArrow(count, f"doc_id long, key long, n_words long, kept {docs.schema['kept'].dataType.simpleString()}")
    return base.join(counted, "key", "left").join(items, "key", "left").select("doc_id", "kept", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
