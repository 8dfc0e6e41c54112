"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary n-gram classifier
(naive Bayes over hashed byte n-grams of order 1 to 3) tells languages with a 1
from those with a 0; its coefficients are log ratios of n-gram counts over all
training texts, summed in tasks.  A text's margins are weighted by each bit's
separation on its training counts and decoded to the codeword of least logistic
loss; the score is that codeword's share, and a small lead marks ambiguity.

Defined cases: text that is null or has no letter is ``und`` with score 0; empty
training data give ``und`` throughout; rows without a language are predicted but
not learned from; every language value is learned, however rare; repeated rows
count each; an empty table gives an empty table; further columns of the input are
kept, but those with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bound_batches, buffers, mix, stash

BITS = 14
ORDERS = (1, 2, 3)
#: Languages counted at once in a task (2**BITS numbers each); of more, a task takes its rows in turns.
LANGUAGES = 64
AMBIGUOUS = 0.6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:33] = 32
_FOLD[48:58] = 48
_ORDER_SALT = np.array([0, 0x51ED27, 0x9E3779, 0xC2B2AE], np.uint64)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits of -1, 1
    weights: np.ndarray  # features x bits
    loss_weights: np.ndarray  # of each bit
    scale: float


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n distinct rows of -1 and 1, far from one another; every column has both values if n > 1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # exhaustive: every way to divide the languages, up to complement
        columns = [[1 if i == 0 or not c >> (i - 1) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(columns).T
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(50):
        m = rng.choice([-1, 1], (n, bits))
        near = (m @ m.T - 2 * bits * np.eye(n)).max()
        if (np.abs(m.sum(axis=0)) < n).all() and (best is None or near < best[0]):
            best = near, m
    return best[1]


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For bounded runs of rows: first, last, and per order the row and the feature of each n-gram."""
    offsets, data = buffers(texts)
    n, first, mask = len(offsets) - 1, 0, np.uint64((1 << BITS) - 1)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES // 2, "right")) - 1)
        part = _FOLD[data[offsets[first] : offsets[last]]]
        row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(offsets[first : last + 1]))
        out, value = [], part.astype(np.uint64)
        for order in ORDERS:
            if order > 1:
                value = (value[:-1] << np.uint64(8)) | part[order - 1 :]
            inside = row[: len(value)] == row[len(row) - len(value) :]
            out.append((row[: len(value)][inside], (mix(value[inside] + (_ORDER_SALT[order] << np.uint64(32))) & mask).astype(np.int32)))
        yield first, last, out
        first = last


def counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(language's place, feature, n) over the columns _text and _lang of all rows."""
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, last, orders in _grams(batch.column(0)):
                for lang in np.unique(own[first:last]).tolist():
                    if lang not in held:
                        if len(held) >= LANGUAGES:
                            yield from out()
                        held[lang] = np.zeros(1 << BITS, np.int64)
                    mine = own[first:last] == lang
                    for row, code in orders:
                        held[lang] += np.bincount(code[mine[row]], minlength=1 << BITS)
        yield from out()

    return rows.mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from the rows of docs where training holds and the language is not null."""
    bound_batches(docs.sparkSession)
    rows = docs.where(training & F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    languages = sorted(r["_lang"] for r in rows.select("_lang").distinct().collect())  # as many as there are languages
    if not languages:
        return None
    table = stash(counts(rows, languages))
    sizes = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    codes = codewords(len(languages))
    bits = codes.shape[1]
    # sums of the languages' shares by bit and side, worked out where the counts are: 2**BITS rows of bits numbers reach the driver
    size = np.array([sizes.get(i, 0) for i in range(len(languages))], np.float64) + 0.5 * (1 << BITS)
    shared = docs.sparkSession.sparkContext.broadcast((codes, size))

    def by_bit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = shared.value
        n = np.zeros(len(size))
        for batch in batches:
            n[np.asarray(batch.column(0))] = np.asarray(batch.column(2))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_log_ratios((n + 0.5) / size, codes).astype(np.float32).tobytes()], pa.binary())], names=["feature", "weights"])

    weights = np.tile(_log_ratios(0.5 / size, codes).astype(np.float32), (1 << BITS, 1))
    for r in table.groupBy("feature").applyInArrow(by_bit, "feature int, weights binary").toLocalIterator():
        weights[r["feature"]] = np.frombuffer(r["weights"], np.float32)
    # mean margin of each language's n-grams by bit, positive if told rightly; a bit weighs as the worst of them
    kept = docs.sparkSession.sparkContext.broadcast(weights)

    def margin(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = shared.value
        lang, n = key[0].as_py(), np.zeros(1 << BITS)
        for batch in batches:
            n[np.asarray(batch.column(1))] = np.asarray(batch.column(2))
        told = ((n + 0.5) / size[lang]) @ kept.value.astype(np.float64) * codes[lang]
        yield pa.RecordBatch.from_arrays([pa.array([told.tobytes()], pa.binary())], names=["margins"])

    lost = np.full(bits, np.inf)
    for r in table.groupBy("lang").applyInArrow(margin, "margins binary").toLocalIterator():
        lost = np.minimum(lost, np.frombuffer(r["margins"]))
    lost = np.where(np.isfinite(lost), np.maximum(lost, 1e-3), 1.0)
    return Model(languages, codes.astype(np.float32), weights, (lost / lost.sum()).astype(np.float32), 1.0)


def _log_ratios(share: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each bit, the log ratio of the mean share of a feature in the languages with 1 and with -1; languages weigh alike."""
    one, zero = (codes > 0).astype(float), (codes < 0).astype(float)
    mean = lambda side: np.where(side.sum(axis=0) > 0, share @ side / np.maximum(side.sum(axis=0), 1), share.mean())
    return np.log(mean(one)) - np.log(mean(zero))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    if model is None:
        return docs.select(*others, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        bits = m.codes.shape[1]
        for texts in batches:
            margin, size = np.zeros((len(texts), bits)), np.zeros(len(texts))
            for first, last, orders in _grams(texts):
                for row, code in orders:
                    size[first:last] += np.bincount(row, minlength=last - first)
                    for b in range(bits):
                        margin[first:last, b] += np.bincount(row, m.weights[:, b][code], last - first)
            # the sum of log ratios of about sqrt(n) independent n-grams, not n: neighbours overlap
            z = margin / np.sqrt(np.maximum(size, 1))[:, None]
            loss = np.stack([(m.loss_weights * np.logaddexp(0, -z * c)).sum(axis=1) for c in m.codes], 1)
            e = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * bits)
            best = loss.argmin(axis=1)
            share = (e / e.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
            yield pa.StructArray.from_arrays([pa.array(np.array(m.languages, object)[best], pa.string()), pa.array(share)], names=["lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    told = docs.select(F.struct(*docs.columns).alias("row"), letters.alias("letters"), decode(F.col(text)).alias("told"))
    score = F.when(F.col("letters"), F.col("told.score")).otherwise(0.0)
    return told.select(*[F.col("row").getField(c).alias(c) for c in others], F.when(F.col("letters"), F.col("told.lang_pred")).otherwise("und").alias("lang_pred"), score.alias("score"), (score < AMBIGUOUS).alias("ambiguous"))
