import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stopwise.llm import components, jaccard, queries


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, num, den):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(400)}"
    texts, n = {}, 0
    for family in range(14):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(len(own))] = word()
            texts[n] = " ".join(own)
            n += 1
    chain = [word() for _ in range(100)]
    for step in range(12):  # links in a row, far ends unlike
        chain = chain[2:] + [word(), word()]
        texts[n] = " ".join(chain)
        n += 1
    boiler = " ".join(word() for _ in range(40))
    for _ in range(25):
        texts[n] = boiler + " " + " ".join(word() for _ in range(rng.randrange(0, 160)))
        n += 1
    for t in (None, "", "  \t", "one", "ONE", "one two", "a b c d", "A b c d", texts[0], texts[0].upper(), "é ß 漢字 ü", "x " * 9000):
        texts[n] = t
        n += 1
    return texts


@pytest.mark.parametrize("k,num,region,block", [(4, 85, 1024, 512), (5, 80, 1024, 7), (4, 85, 6, 4)])
def test_equals_all_pairs(spark, monkeypatch, k, num, region, block):
    """With regions joined as they are, in blocks, and divided by pivots again and again."""
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame([(d, t, "z") for d, t in texts.items()], "doc_id long, text string, n string").repartition(5)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, k, num, 100).collect()}
    assert rows == brute(texts, k, num, 100)


def test_repeats_nulls_and_empty(spark):
    a = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (1, a), (4, a), (None, a), (5, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(docs, 4, 85, 100).collect())
    assert rows == [(1, 1), (1, 1), (4, 1), (5, 5)]
    # one id with unlike texts: documents of their own, each with its links
    other = " ".join(f"u{i}" for i in range(40))
    docs = docs.unionByName(spark.createDataFrame([(4, other), (7, other)], docs.schema))
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, 4, 85, 100).collect())
    assert rows == [(1, 27, 1), (1, 27, 1), (4, 27, 1), (4, 37, 4), (5, 0, 5), (7, 37, 4)]
    assert jaccard.jaccard_join(docs.limit(0), 4, 85, 100).count() == 0


def test_query_on_corpus(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_jaccard_join(spark, sf_dir).collect()}
    assert rows == brute(texts, 4, 85, 100)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = {}
    for d in range(n):
        own = list(base)
        for i in rng.sample(range(words), rng.choice(edits)):
            own[i] = f"e{rng.randrange(50)}"
        out[d] = " ".join(own)
    return out


@pytest.mark.parametrize("region,block", [(1024, 512), (40, 16)])
def test_group_of_loosely_similar_documents(spark, monkeypatch, region, block):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(220, 200, [0, 1, 2, 4, 6, 8, 12], 5)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85, 100).collect()}
    assert rows == brute(texts, 4, 85, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12)), min_size=1, max_size=9))
def test_overlaps_equal_plain_counts(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for i, same in enumerate(jaccard.overlaps(arrays)):
        for j in range(len(sets)):
            if i != j:
                assert same[j] == len(sets[i] & sets[j])


@pytest.mark.parametrize("slice_bytes, held", [(8_000_000, 1 << 21), (100_000, 1_000)])
def test_frequent_shingles_are_counted_over_all_documents(spark, monkeypatch, slice_bytes, held):
    # ids that an eighth of all, drawn by a hash of the id, leaves out
    monkeypatch.setattr(jaccard, "COUNT_BYTES", slice_bytes)
    monkeypatch.setattr(jaccard, "COUNT_TOKENS", held)
    ids = [r[0] for r in spark.range(60_000).where("pmod(xxhash64(id), 1000003) > 125001").limit(31).collect()]
    often, scarce = (",".join(map(str, x)) for x in (ids[:16], ids[16:]))
    text = f"case when id in ({often}) then 'Common pair' when id in ({scarce}) then 'scarce pair' else concat('w', id) end"
    found = jaccard._frequent_shingles(spark.range(60_000).selectExpr("id doc_id", f"{text} text"), 2)
    (_, _, wanted, _), = jaccard._sets(pa.array(["common pair"]), 2)
    assert found.tolist() == wanted.tolist()


def test_frequent_shingles_of_nothing(spark):
    assert len(jaccard._frequent_shingles(spark.createDataFrame([], "doc_id long, text string"), 2)) == 0


def test_tasks_have_one_python_worker(spark, sf_dir, monkeypatch):
    """Links are tables when components contract them; a plan that makes them in the same tasks doubles an executor's workers."""
    plans = []

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components.star_components(links)

    monkeypatch.setattr(jaccard, "star_components", seen)
    jaccard.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
    assert len(plans) >= 2 and not [p for p in plans if "InArrow" in p]
