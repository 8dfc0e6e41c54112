"""Best-fit-decreasing packing of token pieces into sequences.

Texts are tokenised once, in tasks.  Best fit decreasing depends only on how
many pieces there are of each length, so the packing itself is worked out on
that histogram (at most ``limit`` numbers): open bins with equal room are
interchangeable and are kept as ranges of bin numbers, a segment tree over the
remaining capacities finds the tightest room that takes a piece, and whole
ranges are placed at once.  This gives the bins that a piece-by-piece run
gives.  Pieces then look up their bin by their rank among pieces of their
length; ranks come from salted counts, so a frequent length is not one group.

Defined cases: null and empty texts are one end token; rows with a null id are
packed like any other and keep it; repeated rows are packed each on its own; an empty table gives an empty table; further columns are
dropped; very long texts are cut, and only they.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bound_batches, stash

#: Pieces of one length and salt at most, about.
PIECES_PER_SALT = 100_000
LEAST_SALTS = 32

_ENCODERS: dict[tuple[str, str], object] = {}
#: Blocks whose letters, digits and spaces have long been settled, so that two pattern engines divide their text alike.
SETTLED = re.compile("[\x00-\u024f\u0370-\u03ff\u0400-\u04ff\u2000-\u206f\u20a0-\u20b5]*")
_SPECIAL = "<|endoftext|>"


def _encoder(ranks_file: str, model_file: str):
    """ids(text) of the model file's tokenizer.

    Texts of settled blocks without the special token's string take the faster
    encoder over the ranks of the same vocabulary, which gives the same ids
    (tests hold it against the model file); all others take the model file.
    """
    if (ranks_file, model_file) not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        model: list[Tokenizer] = []

        def ids(text: str) -> np.ndarray:
            if _SPECIAL in text or not SETTLED.fullmatch(text):
                model or model.append(Tokenizer.from_file(model_file))
                return np.array(model[0].encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

        _ENCODERS[ranks_file, model_file] = ids
    return _ENCODERS[ranks_file, model_file]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, limit: int = 1024, end_id: int = 2, ranks: str = "byte_bpe_50k.tiktoken", model: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most limit tokens of each text and its end token; of a cut text the first piece has what is left over."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids = _encoder(public_tokenizers.path(ranks), public_tokenizers.path(model))
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at, piece = 0, 0
                while at < len(tokens):
                    size = (len(tokens) - at - 1) % limit + 1 if piece == 0 else limit
                    for c, v in zip(cols, (key, piece, at, size, zlib.crc32(tokens[at : at + size].tobytes())), strict=True):
                        c.append(v)
                    at, piece = at + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tokenise, PIECES)


class CapacityTree:
    """Segment tree over capacities 0..limit: the least capacity of at least x that has open bins."""

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        i = capacity + self.size
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def least(self, x: int) -> int | None:
        i = x + self.size
        if self.some[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, first bin, per bin, offset): pieces of that length ranked from..to-1 go, per bin at a time, to bins from first bin on."""
    tree, open_bins, plan, bins = CapacityTree(limit), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            room, left = tree.least(length), total - rank
            if room is None:
                room, per = limit, limit // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                per = room // length
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            full, some = min(n, left // per), 0
            if full:
                plan.append((length, rank, rank + full * per, first, per, limit - room))
                put(room - per * length, first, full)
                rank += full * per
            if full < n and rank < total:  # the last bin takes fewer
                some = total - rank
                plan.append((length, rank, total, first + full, per, limit - room))
                put(room - some * length, first + full, 1)
                rank = total
            put(room, first + full + bool(some), n - full - bool(some))
    return plan


def pack(docs: DataFrame, limit: int = 1024, **options) -> DataFrame:
    """Each piece with its sequence_id and offset; sequences hold limit tokens at most, without gaps from 0."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, limit, **options).withColumn("_h", F.xxhash64("doc_id", "piece")))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # limit rows at most
    plan = best_fit_decreasing(histogram, limit)
    salts = max(LEAST_SALTS, -(-max(histogram.values(), default=1) // PIECES_PER_SALT))
    salted = cut.withColumn("_salt", F.pmod("_h", F.lit(salts)))
    before = salted.groupBy("length", "_salt").count().withColumn(
        "_before", F.sum("count").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    ).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("length", "_salt").orderBy("_h", "doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_place", place).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    # the plan has a bounded number of rows, whatever the number of pieces
    rows = spark.createDataFrame(plan or [], "length long, _from long, _to long, _first long, _per long, _offset long")
    slot = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(rows), (ranked["length"] == rows["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1))
        .select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("_first") + F.floor(slot / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + (slot % F.col("_per")) * ranked["length"]).cast("long").alias("offset"))
    )
