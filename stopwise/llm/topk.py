"""Exact top-k inner products by block-at-a-time pruning.

Rows lie in blocks of consecutive ids.  A block has a forward index (its
integer vectors) and, for each term (component), its largest and least value.
The sum of ``query * extreme`` over terms bounds every score in the block.  For
each query, blocks are scored in order of that bound until it falls below the
kth score so far.

Blocks are gathered into groups of a bounded size, written with their number;
each batch of queries meets each group once (the stated query set against all
rows, in blocks), and the groups' best k of each query are merged.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; a shorter vector counts as 0 in the missing components; rows with
a null id are dropped; rows with the query's own id are not its candidates;
empty tables give no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash

BLOCK_ROWS = 256
GROUP_ROWS = 16_384
QUERY_ROWS = 1_024
#: Components are held to this number; scores to those of a long, but for the least, which stands for no row.
LARGEST, LEAST_SCORE, MOST_SCORE = 2**62, -(2**63) + 1, 2**63 - 1


def _packed(rows: DataFrame, parts: int, most: int, dims: int) -> DataFrame:
    """Bounded groups of consecutive ids: (ids, vectors) as bytes of int64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            ids = np.concatenate([x[0] for x in held] or [np.zeros(0, np.int64)])
            vectors = np.concatenate([x[1] for x in held] or [np.zeros((0, dims), np.int64)])
            while len(ids) >= most or last and len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids[:most].tobytes()]), pa.array([np.ascontiguousarray(vectors[:most]).tobytes()])], names=["ids", "vectors"])
                ids, vectors = ids[most:], vectors[most:]
            held = [(ids, vectors)]

        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = np.clip(np.floor(256 * np.asarray(lists.flatten(), np.float64)), -LARGEST, LARGEST)
            matrix = np.zeros((len(size), dims), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            held.append((np.asarray(batch.column(0), np.int64), matrix))
            yield from out(False)
        yield from out(True)

    return rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(pack, "ids binary, vectors binary")


def _nearest_long(x: np.ndarray) -> np.ndarray:
    """Doubles as longs, those beyond as the nearest one."""
    out = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    return np.where(np.abs(x) <= 2.0**62, out, np.where(x > 0, MOST_SCORE, LEAST_SCORE))


def best_in_group(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's place, id, score) of the best k of each query among these rows, and how many blocks were scored."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    exact, fits = most < 2**53, most < 2**62
    kind = np.float64 if exact or not fits else np.int64
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    n, q = len(ids), len(query_ids)
    starts = np.arange(0, n, BLOCK_ROWS)
    most, least = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    nothing = np.iinfo(np.int64).min
    scores, found, scored = np.full((q, k), nothing, np.int64), np.full((q, k), np.iinfo(np.int64).max, np.int64), 0
    for turn in range(len(starts)):
        block = order[:, turn]
        own = bounds[np.arange(q), block]
        active = (own if fits else _nearest_long(own)) >= scores[:, -1]  # equal: the block may hold a smaller id
        if not active.any():
            break
        for b in np.unique(block[active]):
            who = np.flatnonzero(active & (block == b))
            part = slice(starts[b], starts[b] + BLOCK_ROWS)
            s = queries[who] @ vectors[part].T
            s = s.astype(np.int64) if fits else _nearest_long(s)
            s[query_ids[who][:, None] == ids[part][None, :]] = nothing
            top = np.argsort(-s.astype(np.float64) if exact else ~s, axis=1, kind="stable")[:, :k]  # ids ascend within a block
            more = np.take_along_axis(s, top, 1)
            more_ids = np.where(more == nothing, np.iinfo(np.int64).max, ids[part][top])
            all_s, all_i = np.concatenate([scores[who], more], 1), np.concatenate([found[who], more_ids], 1)
            keep = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            scores[who], found[who] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_i, keep, 1)
            scored += len(who)
    row, col = np.nonzero(scores != nothing)
    return row, found[row, col], scores[row, col], scored


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; is_query selects the queries by the columns id and vector."""
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"))
    good = plain.where("id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    n, dims = good.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    groups = _packed(good, max(1, -(-n // GROUP_ROWS)), GROUP_ROWS, dims)
    asked = good.where(is_query)
    batches = _packed(asked, max(1, asked.count() // QUERY_ROWS), QUERY_ROWS, dims)
    # the numbers are data once they are written, however many partitions there were
    numbered = stash(groups.withColumn("group", F.spark_partition_id()))
    listed = numbered.select("group").distinct()  # one row for GROUP_ROWS vectors
    spread = batches.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")).join(listed)

    def search(joined: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined:
            for i in range(batch.num_rows):
                ids, vs, query_ids, queries = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in range(4))
                row, found, score, _ = best_in_group(ids, vs.reshape(len(ids), -1), query_ids, queries.reshape(len(query_ids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = numbered.join(spread, "group").select("ids", "vectors", "query_ids", "queries").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
