import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from stopwise.llm import queries, tandem
from stopwise.llm.common import words


def brute(w, power=2, least=0):
    """Maximal stretches by their smallest period, over all periods."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(power * q, least):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def all_runs(symbols):
    got = tandem.runs(np.array([*symbols, 10**6]), len(symbols))
    return sorted(zip(*(x.tolist() for x in got), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
@example([0] * 50)
@example([0, 1] * 20 + [0])
@example(([0, 1, 0, 0, 1] * 5 + [2]) * 3)
def test_all_runs_equal_brute_force(symbols):
    assert all_runs(symbols) == brute(symbols)


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert all_runs(b) == brute(b)
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    assert all_runs(morse) == brute(morse)


def test_walks_are_needed():
    """The squares at block borders alone are not all kinds: the walks find the others."""
    symbols = np.array(list(range(9)) * 4 + [99])
    c = tandem.Classes(symbols)
    start, period = tandem.covering_squares(c, 9)
    node, q = tandem.vocabulary(tandem.SuffixTree(c), start, period)
    assert len(start) < 9 and len(set(node.tolist())) >= 9


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(1, 7)), max_size=6), st.integers(0, 3))
def test_texts_equal_brute_force(parts, seed):
    w = [f"w{x}" for body, times in parts for x in body * times]
    texts = [" ".join(w), "", " \t ".join(w[::-1]) + "\n", None, " ".join(w[seed:])]
    for chunk in words(pa.array(texts), lower=False):
        got = list(zip(*(x.tolist() for x in tandem.word_runs(chunk)), strict=True))
        for row, text in enumerate(texts):
            lo, hi = chunk.bounds[row], chunk.bounds[row + 1]
            assert [(i - lo, n, q) for i, n, q in got if lo <= i < hi] == brute((text or "").split(), 4, 6), text


def test_long_periodic_text():
    body = [f"v{i}" for i in range(4000)]
    w = body * 5 + body[:17]
    (chunk,) = words(pa.array([" ".join(w)]), lower=False)
    got = list(zip(*(x.tolist() for x in tandem.word_runs(chunk)), strict=True))
    assert got == [(0, 20_017, 4000)]


def test_defined_cases(spark):
    rows = [(1, None, 5, "x"), (None, "a b " * 9, 5, "x"), (2, "", 5, "x"), (3, "k k k k k", 5, "x"), (4, "y k k k k k k z", 5, "x"), (4, "y k k k k k k z", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in tandem.periodic_runs(docs).collect())
    assert got == [(0, 18, [(0, 18, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 5, [], "k k k k k"), (4, 8, [(1, 6, 1)], "y k z"), (4, 8, [(1, 6, 1)], "y k z")]
    assert tandem.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tandem.periodic_runs(docs, least=5)


def test_query_on_corpus(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute(w, 4, 6) if len(w) < 4000 else None
        r = rows[d["doc_id"]]
        if want is None:
            continue
        some += len(want)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        best = min(((-n, s, q) for s, n, q in want), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
    assert some > 5
