"""Token counts by a whole-token shortcut: known pre-tokens are counted, only the rest is merged.

``whole_tokens`` proves beforehand, on the driver and once for a vocabulary,
which of its strings the merges of byte-pair encoding turn into one token: every
string is given to the model alone, and those that come back as a single token
with their own id are kept.  A pre-token of a text that is such a string is one
token without a look at the merges.  Tasks divide their texts into pre-tokens,
count those found in the proven set and merge the others, whose counts are kept
in a memory of a bounded number of short strings.

Texts are divided by the vocabulary's pattern.  Blocks of characters that are
younger than the engines' Unicode tables could be divided differently, so a text
with a character outside the long settled blocks is divided by the tokenizer's
own pre-tokenizer.  Special strings inside a text are the token that the
tokenizer makes of them.

Defined cases: null and empty texts have no bytes and no tokens; rows with a null
id are counted and keep it; repeated rows are counted each on its own; an empty
table gives an empty table; further columns are dropped; texts are taken whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .packing import SETTLED

#: Pre-tokens whose merged length a task remembers, and the longest of them.
MEMORY = 200_000
MEMORY_CHARS = 40
COUNTS = "doc_id long, n_bytes long, n_pre_tokens long, n_whole long, n_tokens long"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where it is printable, else the next of those from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _letters(pre_token: str, table: str) -> str:
    return pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)


def checked(model_file: str):
    """The tokenizer of the file, whose parts must be those that the shortcut is proven for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model_file)
    said = json.loads(tokenizer.to_str())
    model, pre = said["model"], said["pre_tokenizer"] or {}
    plain = not (said["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not (plain and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        raise ValueError("the shortcut is for byte-level BPE without normalizer, dropout, affixes and prefix space")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
        raise ValueError("the shortcut is for added tokens that match their own string only")
    return tokenizer, [t["content"] for t in said["added_tokens"]]


def whole_tokens(model_file: str) -> set[str]:
    """The strings of the vocabulary that the merges turn into themselves, as text; strings of broken characters cannot be a pre-token."""
    tokenizer, _ = checked(model_file)
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    proven = set()
    for string, own in tokenizer.get_vocab(with_added_tokens=False).items():
        alone = tokenizer.model.tokenize(string)
        if len(alone) == 1 and alone[0].id == own and all(c in byte for c in string):
            try:
                proven.add(bytes(byte[c] for c in string).decode())
            except UnicodeDecodeError:
                pass
    return proven


class Counter:
    """Counts the tokens of texts; one for each worker."""

    def __init__(self, model_file: str, pattern: str, proven: set[str]) -> None:
        import regex

        self.tokenizer, special = checked(model_file)
        self.divide = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.proven, self.table, self.memory = proven, "".join(byte_letters()), {}

    def pre_tokens(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.divide(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, pre_token: str) -> int:
        n = self.memory.get(pre_token)
        if n is None:
            n = len(self.tokenizer.model.tokenize(_letters(pre_token, self.table)))
            if len(pre_token) <= MEMORY_CHARS:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[pre_token] = n
        return n

    def count(self, text: str) -> tuple[int, int, int]:
        """(pre-tokens and special strings, those of them that are one token by proof, tokens)."""
        parts, special = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            special = len(parts) - 1
        total = whole = tokens = 0
        proven, memory = self.proven, self.memory
        for part in parts:
            found = self.pre_tokens(part)
            rest = [x for x in found if x not in proven]
            total += len(found)
            whole += len(found) - len(rest)
            tokens += sum([memory.get(x) or self.merged(x) for x in rest])
        return total + special, whole + special, tokens + whole + special


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _count(batches: Iterator[pa.RecordBatch], model: str, pattern: str | None, proven) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    key = public_tokenizers.path(model), pattern or public_tokenizers.PATTERN
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(*key, proven.value)
    counter = _COUNTERS[key]
    for batch in batches:
        rows = [(len(text.encode()), *counter.count(text)) if text else (0, 0, 0, 0) for text in (value.as_py() for value in batch.column(1))]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[x.split()[0] for x in COUNTS.split(", ")])


def count_tokens(docs: DataFrame, model: str = "byte_bpe_50k.json", pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pre_tokens, n_whole (those counted by the shortcut), n_tokens of each text."""
    import public_tokenizers

    bound_batches(docs.sparkSession)
    # as large as the vocabulary, whatever the corpus
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(public_tokenizers.path(model)))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(partial(_count, model=model, pattern=pattern, proven=proven), COUNTS)
