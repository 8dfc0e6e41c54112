"""Removal of passages that occur more than once, through phrase automata.

Of each window of ``window`` words, the ``gram``-word phrase with the least hash
(the rightmost of equals) is its anchor; equal windows have equal anchors, so
only phrases that are the anchor in two places can lie in a recurring window.

1. Anchors are counted over the corpus.  A bitmap of fixed size marks the
   recurring ones; a false mark costs time and nothing else.
2. Recurring passages are confirmed.  Texts are dealt to splits by a hash, and
   for each marked anchor a hash of the words around it, without its own, goes
   with its split to the shard of the anchor; no place goes along.  Contexts seen
   twice or more are confirmed.  Each split gets the phrases that its texts may
   hold, with the confirmed words around them.
3. Each split compiles its phrases into an Aho-Corasick automaton and streams its
   whole texts through it.  The hits are the places of the phrases; where the
   words left and right of a hit are a confirmed context, the passage lies there.
   The phrase itself is not compared again: what the automaton does not find is
   not removed, and a text that differs from a passage within a phrase alone
   keeps it.
4. The passages found in a text are merged and their words removed.

Anchors that occur more than ``HOT`` times have no shard of their own: their
contexts are confirmed by a count that is combined before the shuffle.  Words in
the automaton are three symbols each, of 60 bits of their hash in all; contexts
are equal if their 64-bit hashes over 64-bit word hashes are.

Defined cases: null and empty texts have no words; occurrences in repeated rows
count like any other; rows that agree in id and text get equal results; an empty
table gives an empty table; further columns are dropped; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, buffers, mix, span_hash, stash, words

#: Bits of the bitmap of recurring anchors, for each of them, and at most: 16 MB.
BITS_EACH, MOST_BITS = 16, 27
_SLICE_BITS = 15
#: Occurrences of a shard, about; bytes of text of a split, about.
SHARD_TEXTS = 30_000
SPLIT_BYTES = 1 << 20
HOT = 5_000


def _anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's word, hash, first and last window that it anchors) for each run of windows with one anchor."""
    n, run = len(w.row), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none
    grams = span_hash(w.hash, np.arange(n - gram + 1), np.arange(gram, n + 1))
    inside = np.flatnonzero(w.row[: n - window + 1] == w.row[window - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(grams, run)
    at = np.concatenate([none, *[part + run - 1 - view[part, ::-1].argmin(axis=1) for part in np.array_split(inside, max(1, len(inside) // 100_000))]])
    if not len(at):
        return none, none.astype(np.uint64), none, none
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], grams[at[first]], inside[first], inside[last]


def _anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), lower=False):
                anchor, n = np.unique(_anchors(w, window, gram)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(emit, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def _bitmap(recurring: DataFrame, bits: int) -> np.ndarray:
    """One bit for each recurring anchor; slices are put together in tasks, so at most the bitmap's size is collected."""
    low = min(bits, _SLICE_BITS)
    place = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    slices = recurring.select(F.shiftright(place, low).alias("slice"), place.bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("bit")).distinct().groupBy("slice").agg(F.collect_list("bit").alias("bits"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for own in batch.column(1):
                marked = np.zeros(1 << low, bool)
                marked[np.asarray(own.values)] = True
                packed.append(np.packbits(marked, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["slice", "packed"])

    out, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (low - 3)
    for r in slices.mapInArrow(to_bytes, "slice long, packed binary").collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["packed"], np.uint8)
    return out


def _context(h: np.ndarray, at: np.ndarray, gram: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the left words before and the right words after the phrase at each place."""
    before, after = span_hash(h, at - left, at), span_hash(h, at + gram, at + gram + right)
    return mix(before ^ mix(after + (left * 1024 + right).astype(np.uint64)))


SEGMENT = "split int, anchor long, phrase binary, last int, contexts binary, whole long"


def _segments(docs: DataFrame, bitmap: np.ndarray, bits: int, window: int, gram: int) -> DataFrame:
    """For each marked anchor its phrase (8 bytes a word), the context of each of its windows, of the whole they make, and how many words the first window has before it."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    rest = window - gram

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for w in words(batch.column(1), lower=False):
                at, anchor, lo, hi = _anchors(w, window, gram)
                place = (anchor & np.uint64((1 << bits) - 1)).astype(np.int64)
                keep = (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at, anchor, lo, hi = at[keep], anchor[keep], lo[keep], hi[keep]
                n = hi - lo + 1
                each = np.repeat(at, n)
                left = each - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
                contexts = _context(w.hash, each, gram, left, rest - left).astype("<u8").tobytes()
                whole = _context(w.hash, at, gram, at - lo, rest - (at - hi))
                phrases = w.hash.astype("<u8").tobytes()
                ends = np.cumsum(n).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(w.row[lo] + w.first)), pa.array(anchor.view(np.int64)), pa.array([phrases[8 * a : 8 * (a + gram)] for a in at.tolist()], pa.binary()), pa.array(at - lo, pa.int32()),
                        pa.array([contexts[8 * a : 8 * b] for a, b in zip([0, *ends[:-1]] if ends else [], ends, strict=True)], pa.binary()), pa.array(whole.view(np.int64)),
                    ],
                    names=["split", "anchor", "phrase", "last", "contexts", "whole"],
                )

    return docs.select("split", "text").mapInArrow(emit, SEGMENT)


def _blobs(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after another, and where each begins, in units of width (one more at the end)."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(held[offsets[0] : offsets[-1]]), (offsets - offsets[0]) // width


def _numbers(part: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return part.column(name).to_numpy().astype(np.int64)


PASSAGES = "split int, phrase binary, left array<int>, right array<int>, context array<long>"


def _passages(split: np.ndarray, phrase: pa.Array, record: np.ndarray) -> pa.RecordBatch:
    """One row for each split and phrase; record: number of the split and phrase, left, right, context, distinct and in order."""
    which, first = np.unique(record[0], return_index=True)
    cuts = pa.array(np.append(first, len(record[0])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(kind))) for x, kind in zip(record[1:], (np.int32, np.int32, np.int64), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(split[which].astype(np.int32)), phrase.take(pa.array(which)), *lists], names=["split", "phrase", "left", "right", "context"])


def _symbols(h: np.ndarray) -> str:
    """Three symbols for each word hash, of 20 bits each."""
    parts = np.stack([(h >> np.uint64(shift)) & np.uint64(0xFFFFF) for shift in (44, 24, 4)], axis=1)
    return (parts.astype("<u4") + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def automaton(phrases: list[str]):
    """Aho-Corasick automaton of the phrases by their place in the list; None without phrases."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        made.add_word(phrase, k)
    if len(made):
        made.make_automaton()
    return made if len(made) else None


def hits(made, w: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of each place in the texts of a chunk where the automaton finds a phrase."""
    size = 3 * gram
    found = np.array([(end - size + 1, k) for end, k in made.iter(_symbols(w.hash))], np.int64).reshape(-1, 2) if made is not None else np.zeros((0, 2), np.int64)
    found = found[found[:, 0] % 3 == 0]
    at, phrase = found[:, 0] // 3, found[:, 1]
    within = w.row[at] == w.row[at + gram - 1]
    return at[within], phrase[within]


def _covered(w: Words, at: np.ndarray, phrase: np.ndarray, gram: int, left: np.ndarray, right: np.ndarray, context: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a passage: the words around a hit are one of its phrase's contexts."""
    n = first[phrase + 1] - first[phrase]
    each = np.repeat(np.arange(len(at)), n)
    one = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[phrase], n)
    place, l, r = at[each], left[one], right[one]
    begin, end = w.bounds[w.row[place]], w.bounds[w.row[place] + 1]
    inside = (place - l >= begin) & (place + gram + r <= end)
    place, l, r, one = place[inside], l[inside], r[inside], one[inside]
    same = _context(w.hash, place, gram, l, r) == context[one]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, (place - l)[same], 1)
    np.add.at(edge, (place + gram + r)[same], -1)
    return np.cumsum(edge)[:-1] > 0


def passages(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The phrases of confirmed passages that texts of each split (docs: split, text) may hold, with the words around them."""
    bound_batches(docs.sparkSession)
    rest = window - gram
    counts = stash(_anchor_counts(docs, window, gram))
    few = F.when(F.col("n") <= HOT, F.col("n"))
    n, kinds = counts.agg(F.coalesce(F.sum(few), F.lit(0)), F.count("*")).first()
    bits = int(np.clip(np.ceil(np.log2(max(1, kinds) * BITS_EACH)), 10, MOST_BITS))
    hot = counts.where(F.col("n") > HOT).select("anchor", F.lit(True).alias("often"))
    segments = _segments(docs, _bitmap(counts, bits), bits, window, gram)

    def confirm(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(list(batches))
        split, anchor, last, whole = (_numbers(x, c) for c in ("split", "anchor", "last", "whole"))
        data, firsts = _blobs(x.column("contexts"), 8)
        context, size = data.view("<i8"), np.diff(firsts)
        own = np.repeat(np.arange(len(size)), size)
        _, kind, times = np.unique(mix(anchor.view(np.uint64)[own] ^ mix(context.view(np.uint64))), return_inverse=True, return_counts=True)
        twice = times[kind] > 1
        all_ = np.bincount(own, ~twice, len(size)) == 0
        some = np.flatnonzero(twice & ~all_[own])
        left = last[own[some]] - (some - firsts[own[some]])
        each = np.flatnonzero(all_)
        occurrence = np.concatenate([each, own[some]])
        record = [np.concatenate([last[each], left]), np.concatenate([rest - (last[each] - size[each] + 1), rest - left]), np.concatenate([whole[each], context[some]])]
        # the splits and phrases, and their distinct records
        order = np.lexsort((anchor, split))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (split[order][1:] != split[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        table = [number[occurrence], *record]
        order = np.lexsort(table[::-1])
        table = [c[order] for c in table]
        keep = np.ones(len(order), bool)
        keep[1:] = np.any([c[1:] != c[:-1] for c in table], axis=0)
        yield _passages(split, x.column("phrase").combine_chunks(), np.array([c[keep] for c in table]))

    shards = max(1, -(-n // SHARD_TEXTS))
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    if hot.isEmpty():
        return segments.select("*", shard).groupBy("shard").applyInArrow(confirm, PASSAGES)
    segments = stash(segments.join(hot, "anchor", "left"))
    common = segments.where("often is null").select(*segments.columns[:-1], shard).groupBy("shard").applyInArrow(confirm, PASSAGES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, firsts = _blobs(batch.column("contexts"), 8)
            own = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            split, anchor, last = (_numbers(batch, c) for c in ("split", "anchor", "last"))
            left = last[own] - (np.arange(len(own)) - firsts[own])
            table = [split[own], anchor[own], left, data.view("<i8")]
            order = np.lexsort(table)
            table = [c[order] for c in table]
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in table], axis=0)])) if len(order) else order
            n = np.diff(np.concatenate([new, [len(order)]])) if len(order) else order
            columns = [pa.array(c[new], kind) for c, kind in zip(table, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=["split", "anchor", "left", "context", "n"])

    frequent = segments.where("often is not null")
    seen = stash(frequent.select("split", "anchor", "last", "contexts").mapInArrow(emit, "split int, anchor long, left int, context long, n long"))
    twice = seen.groupBy("anchor", "left", "context").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    phrases = frequent.groupBy("anchor").agg(F.min("phrase").alias("phrase"))
    kept = seen.drop("n").join(twice, ["anchor", "left", "context"], "left_semi").distinct()
    listed = kept.groupBy("split", "anchor").agg(F.collect_list(F.struct("left", "context")).alias("all")).join(phrases, "anchor")
    right = F.transform("all", lambda x: F.lit(rest) - x["left"])
    return common.unionByName(listed.select("split", "phrase", F.col("all.left").alias("left"), right.alias("right"), F.col("all.context").alias("context")))


CUT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each text outside windows that recur, joined by a space."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    plain = plain.withColumn("split", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // SPLIT_BYTES))).cast("int"))
    found = passages(plain, window, gram)

    def cut(texts: pa.Table, known: pa.Table) -> pa.Table:
        data, _ = _blobs(known.column("phrase"), 8)
        made = automaton([_symbols(h) for h in data.view("<u8").reshape(-1, gram)])
        lists = [known.column(c).combine_chunks() for c in ("left", "right", "context")]
        left, right, context = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
        first = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths()))]).astype(np.int64)
        column = texts.column("text").combine_chunks()
        offsets, raw = buffers(column)
        raw, totals, gone, kept = raw.tobytes(), [], [], []
        for w in words(column, lower=False):
            covered = _covered(w, *hits(made, w, gram), gram, left, right, context.view(np.uint64), first)
            removed = np.concatenate([[0], np.cumsum(covered)])
            removed = removed[w.bounds[1:]] - removed[w.bounds[:-1]]
            for i, n in enumerate(removed.tolist()):
                own = raw[offsets[w.first + i] : offsets[w.first + i + 1]].split()
                totals.append(len(own))
                gone.append(n)
                kept.append(b" ".join([x for x, c in zip(own, covered[w.bounds[i] : w.bounds[i + 1]].tolist(), strict=True) if not c] if n else own))
        return pa.table([texts.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return plain.groupBy("split").cogroup(found.groupBy("split")).applyInArrow(cut, CUT).select("doc_id", "n_words", "n_removed", "kept")
