import math
import random

import numpy as np
from pyspark.sql import functions as F

from stopwise.llm import queries, topk


def brute(rows, is_query, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if is_query(q):
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(3000, None), (3050, [None] * 6), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, 5).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    center = rng.normal(size=(20, 8)) * 50
    vectors = np.repeat(np.floor(256 * center).astype(np.int64), 256, axis=0) + rng.integers(-50, 50, (20 * 256, 8))
    ids = np.arange(len(vectors))
    _, _, _, scored = topk.best_in_group(ids, vectors, ids[:100], vectors[:100], 5)
    assert scored < 100 * 10


def test_query_on_corpus(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op2_exact_top_k(spark, sf_dir).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_groups_of_any_number_of_partitions(spark, monkeypatch):
    """Small groups, unequal lengths, and more range partitions than groups."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 64)
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(rng.choice([3, 5]))]) for i in range(500)]
    packed = topk._packed
    monkeypatch.setattr(topk, "_packed", lambda df, parts, most, dims: packed(df, 3 * parts + 2, most, dims))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, 5).collect())
    assert got == brute([(i, v + [0.0] * (5 - len(v))) for i, v in rows], lambda i: i % 50 == 0, 5)


def test_huge_components_keep_their_rows(spark):
    """Scores beyond a long are the nearest one; no row is lost."""
    rows = [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert [x[2] for x in got] == [1, 3, 2] and got[0][3] == topk.MOST_SCORE and got[2][3] == topk.LEAST_SCORE
