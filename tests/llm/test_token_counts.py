import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stopwise.llm import queries, token_counts

MODEL = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(MODEL)
PROVEN = token_counts.whole_tokens(MODEL)
COUNTER = token_counts.Counter(MODEL, public_tokenizers.PATTERN, PROVEN)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


CASES = [
    "", " ", "\n\n \t", "the cat's cat'S they'll we'd", "a" * 5000, "x y " * 3000, "<|endoftext|>", "one<|endoftext|> two <|endoftext|><|endoftext|>3", "<|endoftext|", "Čuješ li žubor?", "你好 世界", "՘֋ x\U00010940y", "😀😀 ok",
    "1234567890" * 50, "---===---", "tab\tnew\nline \r\n end  ", "a b c", "\x1c\x1d a\x85b", "zqxj vbnmkl", "ـ̀́e",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(text):
    assert COUNTER.count(text)[2] == by_library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" the", "<|endoftext|>", "\n", "  ", "'s", " naïve", "0"])), max_size=12).map("".join))
def test_equals_library_on_any_text(text):
    assert COUNTER.count(text)[2] == by_library(text)


def test_proof_holds_for_each_string():
    """Every proven string, if it is a pre-token at all, is one token of the library."""
    alone = [x for x in sorted(PROVEN) if COUNTER.pre_tokens(x) == [x]]
    assert len(alone) > 45_000
    assert all(len(e.ids) == 1 for e in LIBRARY.encode_batch(alone, add_special_tokens=False))


def test_rest_is_merged_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 2)
    counter = token_counts.Counter(MODEL, public_tokenizers.PATTERN, PROVEN)
    text = " ".join(f"qzx{i}vkj" for i in range(20)) * 2
    assert counter.count(text)[2] == by_library(text)
    assert len(counter.memory) <= 2
    assert token_counts.Counter(MODEL, public_tokenizers.PATTERN, set()).count("the cat")[1:] == (0, 2)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (None, "the cat", 5, "x"), (2, "", 5, "x"), (2, "", 5, "x")], "doc_id long, text string, n_tokens int, proven string")
    rows = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    assert rows == [(0, 7, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_other_pipelines_are_refused():
    with pytest.raises(ValueError):
        token_counts.checked(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_corpus(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = by_library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    assert sum(r["n_whole"] for r in rows) > 0
