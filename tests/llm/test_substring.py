import hashlib
import random
import re
from collections import Counter

import pytest

from stopwise.llm import queries, substring


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    common = [word() for _ in range(90)]
    texts = []
    for i in range(n):
        t = [word() for _ in range(rng.randrange(0, 150))]
        if i % 3:
            at = rng.randrange(len(t) + 1)
            cut = rng.randrange(0, 40)
            t[at:at] = common[cut : cut + rng.randrange(30, 60)]
        texts.append(" ".join(t))
    loop = " ".join("abc"[i % 3] for i in range(400))
    return [*texts, texts[5], texts[5], None, "", " \t ", loop, "Ünï " + texts[7], "x " * 80, "longword" * 3000]


@pytest.mark.parametrize("hot,split", [(5000, 1 << 20), (8, 1 << 20), (8, 2_000), (5000, 2_000)])
def test_equals_brute_force(spark, monkeypatch, hot, split):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SPLIT_BYTES", split)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, lo int, ranges string")
    rows = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert len(rows) == len(texts)
    for i, (n, gone, kept) in enumerate(brute(texts, 35)):
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept"]) == (n, gone, kept), i


def test_null_ids_repeats_and_empty(spark):
    a = " ".join(f"q{i}" for i in range(50))
    docs = spark.createDataFrame([(None, a), (1, a), (1, a), (2, None)], "doc_id long, text string")
    rows = substring.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 50), (1, 50), (1, 50), (2, 0)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_query_on_corpus(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = list(texts)
    want = dict(zip(ids, brute([texts[i] for i in ids], 35)))
    rows = queries.op4_repeated_passages(spark, sf_dir).collect()
    assert len(rows) == len(ids)
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_words_with_equal_codes_differ(spark):
    """Words that share the leading 20 bits of their hash: the windows differ all the same."""
    for place in (0, 17, 34):
        one = [f"k{i}" for i in range(35)]
        two = list(one)
        one[place], two[place] = "n386", "n1353"
        docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, "b " + " ".join(one))], "doc_id long, text string")
        assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()} == {1: 35, 2: 0, 3: 35}


def test_batches_without_recurring_windows(spark, monkeypatch):
    """Frequent anchors whose windows recur in few batches of many."""
    monkeypatch.setattr(substring, "HOT", 2)
    phrase = " ".join(f"p{i}" for i in range(34))
    texts = [f"{i} x{i} " + phrase + f" y{i}" for i in range(40)] + ["same " + phrase] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    rows = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert rows == dict(enumerate(gone for _, gone, _ in brute(texts, 35)))


def one_word_off():
    """Two equal texts, and for every place a text that differs from them in that word alone."""
    passage = [f"w{i}" for i in range(35)]
    texts = [passage, passage] + [[*passage[:i], f"z{i}", *passage[i + 1 :]] for i in range(35)]
    return [" ".join(t) for t in texts]


def test_the_automaton_locates_the_passages(spark, monkeypatch):
    """A text that differs within the phrase alone is kept; if any place counted as a hit, it would go."""
    texts = one_word_off()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = lambda: {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    want = dict(enumerate(gone for _, gone, _ in brute(texts, 35)))
    assert removed() == want and sum(want.values()) == 70

    import numpy as np

    def everywhere(made, w, gram):
        at = np.flatnonzero(w.row[: len(w.row) - gram + 1] == w.row[gram - 1 :])
        return np.repeat(at, len(made)), np.tile(np.arange(len(made)), len(at))

    monkeypatch.setattr(substring, "hits", everywhere)
    assert sum(removed().values()) == 70 + 8 * 35  # the texts that differ in a word of the phrase
    monkeypatch.setattr(substring, "hits", lambda made, w, gram: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert sum(removed().values()) == 0
