import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stopwise.llm import packing, queries

RANKS, MODEL = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


def naive_bins(lengths, limit):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = limit
        room.append(r - n)
    return sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_equals_piecewise_best_fit(lengths):
    plan = packing.best_fit_decreasing(dict(Counter(lengths)), 40)
    used, spans = defaultdict(int), defaultdict(list)
    for n, lo, hi, first, per, offset in plan:
        for i in range(hi - lo):
            spans[first + i // per].append((offset + i % per * n, n))
    for b, parts in spans.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        used[b] = at
    assert sorted(40 - x for x in used.values()) == naive_bins(lengths, 40)
    assert sorted(n for parts in spans.values() for _, n in parts) == sorted(lengths)


def check(rows, texts, limit=1024):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in texts:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        at = 0
        for r in pieces:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == limit for r in pieces[1:])
        want[d] = len(ids)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit
    return len(by), sum(want.values())


def test_cases(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "a <|endoftext|> b"), (5, "é" * 3000), (6, "same"), (7, "same")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, length int")
    check(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_query_on_corpus(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bins, tokens = check(queries.op10_best_fit_packing(spark, sf_dir).collect(), texts)
    assert bins <= -(-tokens // 1024) * 1.02 + 1


@functools.cache
def encoders():
    return Tokenizer.from_file(MODEL), packing._encoder(RANKS, MODEL)


def same_ids(texts):
    model, ids = encoders()
    for t in texts:
        assert ids(t).tolist() == model.encode(t, add_special_tokens=False).ids, t[:80]


def test_ids_are_those_of_the_model_file(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").where("text is not null").select("text").collect()
    same_ids([r["text"] for r in rows])
    same_ids(["x" * 30_000, "ab1" * 9_000, "e\u0301" * 500, "\x00\x01\x1f\x7f\x85 \u2028\u00a0\u3000 a\tb\r\n\n  c", "'S 't we'RE it's", " " * 3000 + "z", "\u4e2d\u6587 \U0001f600\u200d\U0001f468 \u0e01\u0e34", "<|endoftext|>a"])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_ids_of_any_text(text):
    same_ids([text])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x20B5), max_size=60))
def test_ids_of_text_in_settled_blocks(text):
    same_ids([text])


def test_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 4), (3, 4), (3, 4)]
    assert sorted(r["offset"] for r in rows)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
