"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A token is coded as the bits of its Huffman path.  Tokens that occur often enough
in training (``LEAST`` times; ``LEAST_SYMBOLS`` tokens in any case and ``SYMBOLS``
at most, the most frequent ones) have a path of their own; one symbol stands for all others, which then cost their share
of the others' counts.  So probabilities are over the training vocabulary and one
unknown token, as in the add-half unigram base.

Each bit is predicted by several models: its node in the Huffman tree (order 0),
hashed contexts of the node with one and with two preceding words, and the
document's own counts so far, which are updated online.  Predictions are
combined in the logistic domain by weights from a set that a gate chooses
(depth, and how often the longest context was seen); weights are updated online,
block by block of each document.  The mixed probability is refined by an
adaptive map from gate and predicted value to observed frequency, which is
updated online as the weights are.

Token counts and context counts are gathered over all training texts: counts in
tasks, sums by shuffles.  The slots of hashed contexts grow with the training
tokens, 1 for 8 tokens about, up to 2**``SLOT_BITS`` for each order, which bounds what
is broadcast; tokens beyond ``BROADCAST_TOKENS`` reach their documents by a join.
Initial weights and the refining map come from all training documents too, with
each bit's own count taken out; they are learned in groups of texts that a hash
of id and text makes, so scores do not depend on how the input is partitioned.

Defined cases: null and empty texts are one end token; rows with a null id are
scored like any other; repeated rows are scored each on its own; without training rows all tokens are unknown; an empty table
gives an empty table; further columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, buffers, heaviest, mix, stash, words

#: Tokens with a Huffman code of their own: those that occur so often, but so many at least and at most.
LEAST, LEAST_SYMBOLS, SYMBOLS = 64, 4_096, 32_768
#: Tokens whose counts are broadcast, at most; counts of others reach their documents by a join.
BROADCAST_TOKENS = 100_000
#: Bits by which the broadcast tokens are looked up first.
FIRST_BITS = 18
#: Slots of each order's contexts: 2**LEAST_BITS to 2**SLOT_BITS (4 bytes each).
LEAST_BITS, SLOT_BITS = 16, 20
ORDERS = 2
#: Counters of a document's own bits: 2**OWN_BITS.
OWN_BITS = 12
#: Tokens of a document's first block, and of its last ones: blocks double in size, and their rate falls with the root of it.
BLOCK, LAST_BLOCK = 64, 1_024
RATE = 0.02
#: Training tokens of a group of texts that learns weights of its own, about, and parts of one in which their sums are counted.
GROUP_TOKENS, WHOLE = 1_000_000, 1 << 20
INPUTS = 5  # order 0, order 1, order 2, the document, bias
DEPTHS, SEEN_BITS = 14, 2
SEEN = 1 << SEEN_BITS
STEPS = 33
#: Bits of Code.packed below the depth.
DEPTH_AT = 26
#: Bits, about, of a slice: its arrays stay in the processor's cache from one operation to the next.
SLICE = 16_384

END = np.uint64(0x5EED0FE4D)
#: Sums of the runs of an array that begin at given places.
run_sums = np.add.reduceat


class Code(NamedTuple):
    """Huffman paths: for symbol s, node and bit at from[s]..from[s + 1]."""

    begin: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    nodes: int
    salts: np.ndarray  # of each node
    packed: np.ndarray  # at each place of a path: node, bit and depth in one number, so that one look finds all


class Model(NamedTuple):
    tokens: np.ndarray  # sorted hashes of broadcast tokens
    symbol: np.ndarray  # of each, the last one if none of its own
    logs: np.ndarray  # log10(c + 0.5) of each
    code: Code
    bits: int  # of the number of a slot
    seen: list[np.ndarray]  # per order and slot: zeros and ones seen, 16 bits of a number each, so that one look finds both
    weights: np.ndarray
    refine: np.ndarray  # gate x step: refined stretch
    first: np.ndarray | None = None  # first_places of the tokens


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, serial = {}, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[serial] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], serial, serial))
        serial += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    todo = [(heap[0][2], [])]
    while todo:
        x, path = todo.pop()
        if x in children:
            n = serial - 1 - x  # the root is node 0
            for bit, child in enumerate(children[x]):
                todo.append((child, [*path, (n, bit)]))
        else:
            paths[x] = path
    begin = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    flat = [x for p in paths for x in p]
    node, bit, nodes = np.array([n for n, _ in flat], np.int64), np.array([b for _, b in flat], np.int8), max(1, serial - len(counts))
    depth = np.minimum(np.arange(len(node)) - np.repeat(begin[:-1], np.diff(begin)), DEPTHS - 1)
    return Code(begin, node, bit, nodes, mix(np.arange(1, nodes + 1, dtype=np.uint64)), (depth << DEPTH_AT | node << 1 | bit).astype(np.int32))


def keep_memory() -> None:
    """Let the C library keep freed arrays of a task for the next ones, whose pages are then not made anew."""
    np.empty(31 << 20, np.uint8)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Events(NamedTuple):
    """The bits of a run of texts in order of (block, whether the row ends in it, row, place)."""

    row: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    slots: list[np.ndarray]
    bounds: np.ndarray  # where each block begins; one more at the end
    ending: np.ndarray  # where the bits of rows that end in it begin in each block
    runs: np.ndarray  # where the bits of a row in a block begin


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For bounded runs of rows: first, last, and row and hash of each token, the end token included."""
    for w in words(texts):
        rows = w.last - w.first
        at = w.bounds[1:]
        yield w.first, w.last, np.insert(w.row, at, np.arange(rows)), np.insert(w.hash, at, END)


def contexts(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its place in its row, and 32-bit hashes of the word before and of the two before, side by side."""
    n = len(row)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    place = np.arange(n) - np.repeat(start, np.diff(np.concatenate([start, [n]])))
    one = np.where(place > 0, np.concatenate([[END], h[:-1]]), END)
    two = mix(np.where(place > 1, mix(np.concatenate([[END, END], h[:-2]])[:n] + np.uint64(77)) ^ one, one + np.uint64(5)))
    return place, mix(one) >> np.uint64(32) | two & np.uint64(0xFFFFFFFF00000000)


def spans(hashes: np.ndarray, symbol: np.ndarray, code: Code) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The bits of tokens, a slice of whole tokens at a time: first bit, last bit, Code.packed, node, and hashes of it with each of the two contexts, side by side."""
    begin = code.begin.take(symbol)
    size = code.begin.take(symbol + 1) - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    begin -= ends[:-1]
    cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, ends[-1], SLICE)), [len(symbol)]])).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        a, b, times = int(ends[i]), int(ends[j]), size[i:j]
        at = np.repeat(begin[i:j], times)
        at += np.arange(a, b)
        packed = code.packed.take(at, mode="clip")
        node = ((packed & (1 << DEPTH_AT) - 1) >> 1).astype(np.int64)
        h = np.repeat(hashes[i:j], times)
        h ^= code.salts.take(node, mode="clip")
        halves = h.view(np.uint32)
        halves *= np.uint32(0x9E3779B1)
        yield a, b, packed, node, h


def slots_of(h: np.ndarray, bits: int, into: list[np.ndarray]) -> None:
    """The slots of both contexts from hashes that spans() gave, which are overwritten."""
    np.right_shift(h, np.uint64(64 - bits), out=into[1].view(np.uint64))
    h &= np.uint64(0xFFFFFFFF)
    np.right_shift(h, np.uint64(32 - bits), out=into[0].view(np.uint64))


def events(row: np.ndarray, h: np.ndarray, symbol: np.ndarray, code: Code, bits: int) -> Events:
    place, hashes = contexts(row, h)
    doubled = int(np.log2(LAST_BLOCK // BLOCK))
    block = np.where(place < LAST_BLOCK, np.floor(np.log2(place // BLOCK + 1)), doubled - 1 + place // LAST_BLOCK).astype(np.int32)
    # tokens are in order of row and place, so a stable sort by block, and by whether it is the row's last one, is enough
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([new, [len(row)]]))
    block <<= 1
    block += block == np.repeat(block[new + size - 1], size)
    order = np.argsort(block, kind="stable")
    block, by, row = block[order], symbol[order], row[order]
    ends = np.concatenate([[0], np.cumsum(code.begin[by + 1] - code.begin[by])])
    n = int(ends[-1])
    node, bit, depth, slots = np.empty(n, np.int64), np.empty(n, np.int8), np.empty(n, np.int64), [np.empty(n, np.int64) for _ in range(ORDERS)]
    for a, b, packed, at, h in spans(hashes[order], by, code):
        node[a:b] = at
        bit[a:b] = packed & 1
        depth[a:b] = packed >> DEPTH_AT
        slots_of(h, bits, [x[a:b] for x in slots])
    blocks = (int(block[-1]) >> 1) + 1 if len(block) else 0
    bounds = ends[np.searchsorted(block, 2 * np.arange(blocks + 1))]
    ending = ends[np.searchsorted(block, 2 * np.arange(blocks) + 1)]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
    runs = ends[first]
    return Events(np.repeat(row[first], np.diff(np.concatenate([runs, [n]]))), node, bit, depth, slots, bounds, ending, runs)


def run(ev: Events, rows: int, m: Model, weights: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log2 probability of each row, each with weights and a map of its own that go on from the model's.

    With learn: no probabilities, but the weights (one set for all rows, which move
    by the mean of what the rows ask for) and the counts for the refining map, each
    bit's own count taken out.
    """
    gates, one32 = DEPTHS * SEEN, np.float32(1)
    w = [np.array(x, np.float32) if learn else np.tile(x.astype(np.float32), rows) for x in weights.T]
    # of NumPy's own type object, which an unpickled array's is not: indexed additions are then fast
    refine = None if learn else np.tile(m.refine.astype(np.float32), rows)
    # zeros and ones side by side, so that one look finds both
    seen = np.zeros(2 * rows << OWN_BITS, np.float32)
    pairs = seen.view(np.complex64)
    total, table = np.zeros(rows), np.zeros((gates * STEPS, 2))
    bias, most = np.float32(0.3), np.float32(14)
    # order 0 for each node, or for node and bit if the bit's own count is taken out
    both, own = m.seen[0], np.zeros(1, np.float32)
    if learn:
        both, own = np.repeat(both, 2), np.tile(np.array([0, 1], np.float32), m.code.nodes)
    z, o = (both >> np.uint32(16)).astype(np.float32), (both & np.uint32(0xFFFF)).astype(np.float32)
    if learn:
        z, o = np.maximum(z - (one32 - own), 0), np.maximum(o - own, 0)
    odds = (o + np.float32(0.4)) / (z + np.float32(0.4))
    # its input, and the others' prior count of ones
    order_0 = np.empty(len(odds), np.complex64)
    order_0.real, order_0.imag = np.log(odds), 2 * np.clip(odds / (one32 + odds), np.float32(1e-6), np.float32(1 - 1e-6))
    # places are all in range: take does not look again if told to clip; one table after the other stays in the cache
    counts = [x.take(at, mode="clip") for x, at in zip(m.seen[1:], ev.slots, strict=True)]
    cost = np.empty(0 if learn else len(ev.bit), np.float32)  # of each bit: minus the logarithm of its probability
    largest = int((ev.ending - ev.bounds[:-1]).max(initial=0))
    spot = np.empty(largest, np.int64)
    near, missed = (np.empty(0 if learn else largest, t) for t in (np.int64, np.float32))
    seen_cells, nearness = (np.zeros(2 * len(table) if learn else 0) for _ in range(2))
    for k, (begin, ending, end) in enumerate(zip(ev.bounds[:-1].tolist(), ev.ending.tolist(), ev.bounds[1:].tolist(), strict=True)):
        rate = np.float32(RATE / np.sqrt(min(2 ** max(0, k - 1), LAST_BLOCK // BLOCK)))
        moves = [np.zeros(len(x), np.float64 if learn else np.float32) for x in w]
        # a slice at a time; what it learns counts after the block, and not for rows that end in it
        for a in (*range(begin, ending, SLICE), *range(ending, end, SLICE)):
            last = a >= ending
            b = min(a + SLICE, end if last else ending)
            r, node, bit, inside = ev.row[a:b], ev.node[a:b], ev.bit[a:b], slice(a - begin, b - begin)
            y = bit.astype(np.float32)
            zero = one32 - y
            at = node
            if learn:
                at = node << 1
                at += bit
            prior = order_0.take(at, mode="clip")
            x, for_one = [prior.real.copy()], prior.imag.copy()
            for_zero = np.float32(2) - for_one
            for both in counts:
                both = both[a:b]
                o = (both & np.uint32(0xFFFF)).astype(np.float32)
                z = (both >> np.uint32(16)).astype(np.float32)
                if learn:
                    # the bit's own count is one of them, if any
                    z -= zero
                    o -= y
                    np.maximum(z, np.float32(0), out=z)
                    np.maximum(o, np.float32(0), out=o)
                n = z + o
                o += for_one
                z += for_zero
                o /= z
                x.append(np.log(o, out=o))
            often = (n >= 3).view(np.int8)
            often += (n >= 30).view(np.int8)
            often += (n >= 300).view(np.int8)
            gate = ev.depth[a:b] << SEEN_BITS
            gate += often
            for_one *= np.float32(1.5)
            for_zero *= np.float32(1.5)
            if k or not last:
                key = node * np.int64(0x9E3779B1)
                key >>= 7
                key &= (1 << OWN_BITS) - 1
                key += r << OWN_BITS
            if k:
                own = pairs.take(key, mode="clip")
                for_one += own.imag
                for_zero += own.real
            if not last:
                key <<= 1
                np.add(key, bit, out=spot[inside])
            for_one /= for_zero
            x += [np.log(for_one, out=for_one), bias]
            g = gate
            if not learn:
                g = r * gates
                g += gate
            dot = w[INPUTS - 1].take(g, mode="clip")
            dot *= bias
            for i in range(INPUTS - 1):
                part = w[i].take(g, mode="clip")
                part *= x[i]
                dot += part
            np.minimum(dot, most, out=dot)
            np.maximum(dot, -most, out=dot)
            away = np.exp(-dot)
            step = dot + most
            step *= np.float32((STEPS - 1) / 28)
            whole = np.floor(step)
            np.minimum(whole, np.float32(STEPS - 2), out=whole)
            step -= whole
            # the cell of the refining map, of the row's own if it has one
            left = g * STEPS
            left += whole.astype(np.int64)
            if learn or not last:
                error = away + one32
                np.divide(-rate, error, out=error)
                error += rate * y
            if learn:
                # a bit counts for the two cells about it, each by its nearness
                left <<= 1
                left += bit
                seen_cells += np.bincount(left, minlength=len(seen_cells))
                nearness += np.bincount(left, step, len(nearness))
                for i in range(INPUTS):
                    moves[i] += np.bincount(g, error * x[i], gates)
                continue
            refined = refine.take(left, mode="clip")
            rise = refine[1:].take(left, mode="clip")
            rise -= refined
            rise *= step
            refined += rise
            unlike = np.exp(-refined)
            # odds against a one are the root of both's; a zero has them times the probability of a one
            away *= unlike
            np.sqrt(away, out=away)
            away += one32
            np.log(away, out=cost[a:b])
            dot += refined
            dot *= np.float32(0.5)
            dot *= zero
            cost[a:b] += dot
            if last:
                continue
            for i in range(INPUTS):
                np.add.at(moves[i], g, error * x[i])
            # the nearer cell learns what the refined value missed
            unlike += one32
            np.divide(-rate, unlike, out=unlike)
            np.add(unlike, rate * y, out=missed[inside])
            np.add(left, step > 0.5, out=near[inside])
        if learn:
            active = np.float32(np.searchsorted(ev.runs, end) - np.searchsorted(ev.runs, begin))
            moves = [x.astype(np.float32) / active for x in moves]
        else:
            np.add.at(refine, near[: ending - begin], missed[: ending - begin])
        for x, move in zip(w, moves, strict=True):
            x += move
        np.add.at(seen, spot[: ending - begin], one32)
    if learn:
        upper = nearness.reshape(-1, 2)
        count = seen_cells.reshape(-1, 2) - upper
        count[1:] += upper[:-1]
        table = np.stack([count.sum(axis=1), count[:, 1]], axis=1)
    if not learn and len(cost):
        # the bits of a row and block are summed first, whatever rows are beside them
        total = np.bincount(ev.row[ev.runs], run_sums(cost.astype(float), ev.runs), rows) / -np.log(2)
    return total, np.stack(w, axis=1), table


def first_places(tokens: np.ndarray) -> np.ndarray:
    """Of each value of FIRST_BITS first bits, the place of the first of the sorted tokens that has it, or of a later one."""
    return np.minimum(np.searchsorted(tokens >> np.uint64(64 - FIRST_BITS), np.arange(1 << FIRST_BITS, dtype=np.uint64)), max(0, len(tokens) - 1))


def _symbols(h: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each token, and its place among the broadcast tokens (-1: not one of them)."""
    if not len(m.tokens):
        return np.full(len(h), len(m.code.begin) - 2), np.full(len(h), -1)
    place = m.first.take((h >> np.uint64(64 - FIRST_BITS)).view(np.int64))
    # few tokens have the same first bits, so the next ones are looked at in turn
    rest = np.flatnonzero((m.tokens.take(place) < h) & (place < len(m.tokens) - 1))
    while len(rest):
        next_place = place[rest] + 1
        place[rest] = next_place
        rest = rest[(m.tokens.take(next_place) < h[rest]) & (next_place < len(m.tokens) - 1)]
    place = np.where(m.tokens.take(place) == h, place, -1)
    return np.where(place >= 0, m.symbol[place], len(m.code.begin) - 2), place


def _token_counts(rows: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            parts = [h for _, _, _, h in tokens(batch.column(0))]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return rows.select("text").mapInArrow(emit, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_SLICES = 64


def _within(zeros_ones: np.ndarray) -> np.ndarray:
    """Zeros and ones of each row in 16 bits of a number each; larger counts keep their ratio."""
    most = zeros_ones.max(axis=1, keepdims=True)
    total = np.where(most > 65_535, np.maximum(zeros_ones * 65_535 // np.maximum(most, 1), zeros_ones > 0), zeros_ones)
    return (total[:, 0] << 16 | total[:, 1]).astype(np.uint32)


def _node_counts(code: Code, counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of each node: a symbol's tokens all go its path."""
    total = np.zeros(2 * code.nodes, np.int64)
    np.add.at(total, code.packed & (1 << DEPTH_AT) - 1, np.repeat(counts.astype(np.int64), np.diff(code.begin)))
    return _within(total.reshape(-1, 2))


def _context_counts(rows: DataFrame, shared) -> list[np.ndarray]:
    """Zeros and ones seen in the slots of each order's contexts: tables of bounded size, summed slice by slice in tasks."""
    bits = shared.value.bits
    size = ORDERS << bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        m, total = shared.value, np.zeros(2 * size, np.uint32)
        # zeros and ones side by side, so that one addition finds both
        both, unit = total.view("<u8"), np.array([1, 1 << 32], np.uint64)
        for batch in batches:
            for _, _, row, h in tokens(batch.column(0)):
                for a, b, packed, _, hashes in spans(contexts(row, h)[1], _symbols(h, m)[0], m.code):
                    seen, slots = unit.take(packed & 1, mode="clip"), [np.empty(b - a, np.int64) for _ in range(ORDERS)]
                    slots_of(hashes, bits, slots)
                    for i, at in enumerate(slots):
                        np.add.at(both[i << bits : i + 1 << bits], at, seen)
        for i, part in enumerate(np.split(total, _SLICES)):
            # a task's counts in 16 bits, of larger ones the rest in rows of their own
            while part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(part, 65_535).astype("<u2").tobytes()], pa.binary())], names=["slice", "counts"])
                part = part - np.minimum(part, np.uint32(65_535))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size // _SLICES, 2), np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), "<u2").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_within(total).astype("<u4").tobytes()], pa.binary())], names=["slice", "counts"])

    parts = rows.select("text").mapInArrow(emit, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    both = np.zeros(size, np.uint32)
    for r in parts.toLocalIterator():  # size numbers, whatever the corpus
        at = r["slice"] * (size // _SLICES)
        both[at : at + size // _SLICES] = np.frombuffer(r["counts"], "<u4")
    return np.split(both, ORDERS)


def _mixing(rows: DataFrame, shared, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the refining map, learned in groups of texts and averaged.

    A text's group and its place in it follow from a hash of its id and text, and
    sums are of whole numbers, so neither the input's partitions nor their order
    change the result.
    """
    gates = DEPTHS * SEEN
    shape = "n long, weights binary, table binary"

    def learn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        m = shared.value
        w, table, n = m.weights, np.zeros((gates * STEPS, 2)), 0
        for first, last, row, h in tokens(pa.Table.from_batches(list(batches)).sort_by("place").column("text")):
            _, w, more = run(events(row, h, _symbols(h, m)[0], m.code, m.bits), last - first, m, w, True)
            table, n = table + more, n + last - first
        whole = lambda x: np.rint(x.astype(np.float64) * WHOLE).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([whole(n * w.astype(np.float64))], pa.binary()), pa.array([whole(table)], pa.binary())], names=["n", "weights", "table"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, table = 0, np.zeros(gates * INPUTS, np.int64), np.zeros(gates * STEPS * 2, np.int64)
        for batch in batches:
            n += sum(batch.column(1).to_pylist())
            for x in batch.column(2):
                w += np.frombuffer(x.as_buffer(), np.int64)
            for x in batch.column(3):
                table += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary())], names=["n", "weights", "table"])

    place = F.xxhash64("doc_id", "text")
    group = F.pmod(place, F.lit(max(1, total // GROUP_TOKENS)))
    each = rows.select("text", place.alias("place"), group.alias("group")).groupBy("group").applyInArrow(learn, shape)
    # a row of fixed size from each group, added up in slices
    parts = each.select((F.spark_partition_id() % _SLICES).alias("slice"), "n", "weights", "table").groupBy("slice").applyInArrow(add, shape).collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return shared.value.weights, shared.value.refine
    w = sum(np.frombuffer(r["weights"], np.int64) for r in parts).reshape(gates, INPUTS) / (n * WHOLE)
    table = sum(np.frombuffer(r["table"], np.int64) for r in parts).reshape(-1, 2) / WHOLE
    prior = np.tile(squash(np.linspace(-14, 14, STEPS)), gates)
    return w.astype(np.float32), np.clip(stretch(np.clip((table[:, 1] + 20 * prior) / (table[:, 0] + 20), 1e-6, 1 - 1e-6)), -14, 14).astype(np.float32)


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null for a text of no bytes) of every text; training selects rows by doc_id."""
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    learned = plain.where(training)
    counts = stash(_token_counts(learned))
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = float(np.log10(total + 0.5 * (vocabulary + 1)))
    table = heaviest(counts, BROADCAST_TOKENS).select("token", "n").toArrow()
    token, n = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.lexsort((token, -n))
    token, n = token[order], n[order]
    own = min(SYMBOLS, len(n), max(LEAST_SYMBOLS, int((n >= LEAST).sum())))
    top_n = int(n[:own].sum())
    own_counts = np.concatenate([n[:own], [total - top_n]]) if own else np.zeros(2, np.int64)
    code = huffman(own_counts if own else own_counts + 1)
    symbol = np.minimum(np.arange(len(n)), own)
    order = np.argsort(token)
    token, n, symbol = token[order], n[order], symbol[order]
    bits = int(np.clip(np.ceil(np.log2(max(1, total))) - 3, LEAST_BITS, SLOT_BITS))
    other = float(np.log10(max(0.5, total - top_n + 0.5 * (vocabulary - own + 1))))  # what the other tokens' shares add up to
    gates = DEPTHS * SEEN
    start = np.tile(np.array([0.1, 0.45, 0.25, 0.3, 0.0], np.float32), (gates, 1))
    m = Model(token, symbol, np.log10(n.astype(float) + 0.5), code, bits, [], start, np.tile(np.linspace(-14, 14, STEPS).astype(np.float32), gates), first_places(token))
    sc = docs.sparkSession.sparkContext
    m = m._replace(seen=[_node_counts(code, own_counts), *_context_counts(learned, sc.broadcast(m))])
    weights, refine = _mixing(learned, sc.broadcast(m), total)
    shared = sc.broadcast(m._replace(weights=weights, refine=refine))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        m = shared.value
        rare = len(m.code.begin) - 2
        for batch in batches:
            for first, last, row, h in tokens(batch.column(2)):
                rows = last - first
                symbol, place = _symbols(h, m)
                bits, _, _ = run(events(row, h, symbol, m.code, m.bits), rows, m, m.weights, False)
                logs = np.where(place >= 0, m.logs[place] if len(m.logs) else 0.0, 0.0)
                known = place >= 0
                # tokens that are not broadcast, once for each row
                far = np.flatnonzero(~known)
                order = far[np.lexsort((h[far], row[far]))]
                new = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])]) if len(order) else np.zeros(0, bool)
                times = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])) if len(order) else np.zeros(0, np.int64)
                once = order[new]
                ends = np.searchsorted(row[once], np.arange(rows + 1)).astype(np.int32)
                size = np.bincount(row, minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(size, pa.int64()), pa.array(np.bincount(row, known, rows).astype(np.int64)),
                        pa.array(np.bincount(row, logs, rows)), pa.array(np.bincount(row, np.where(symbol == rare, logs, 0.0), rows)), pa.array(np.bincount(row, symbol == rare, rows).astype(np.int64)), pa.array(bits), pa.array(np.diff(buffers(batch.column(2).slice(first, rows))[0]), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(h[once].view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())),
                    ],
                    names=["doc_id", "row", "n_tokens", "n_near", "near", "near_rare", "n_rare", "bits", "n_bytes", "far", "times"],
                )

    shape = f"{plain.schema['doc_id'].dataType.simpleString()}"
    local = stash(plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(emit, f"doc_id {shape}, row long, n_tokens long, n_near long, near double, near_rare double, n_rare long, bits double, n_bytes long, far array<long>, times array<int>"))
    far = local.where(F.size("far") > 0).dropDuplicates(["row"]).select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("token"), F.col("x.times").alias("times"))
    found = far.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_far"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("far_log"))
    whole = local.drop("far", "times").join(found, "row", "left")
    logs = F.coalesce("far_log", F.lit(0.0))
    result = F.col("bits") * F.lit(float(np.log10(2))) + F.col("near_rare") + logs - F.col("n_rare") * F.lit(other)
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("near") + logs - F.col("n_tokens") * F.lit(base)).alias("base_score"), result.alias("score"),
        (result / F.lit(-float(np.log10(2))) / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )
