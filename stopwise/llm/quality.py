"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Texts become sets of hashed word 1- and 2-grams and a few form features (length,
repetition, share of digits and marks, each in bins).  Log-count ratios come
from all labelled training rows, summed in tasks.  The hinge-loss model is fitted
by dual coordinate descent on a bounded sample of labelled rows: in the order of
a hash of the id, the first ``FIT_ROWS`` and of these as many as have
``FIT_FEATURES`` features together.  One task fits it; the coefficients,
2**``BITS`` numbers, are broadcast for scoring.

Defined cases: null and empty texts have only form features and are scored like
any text; labels other than 0 and 1 are ignored; repeated labels count once per
document and label; without labels of both classes every score is 0.5; an empty
table gives an empty table; further columns of the input are kept, but one with
the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, column, mix, stash, words

BITS = 18
#: Labelled rows that the hinge-loss model is fitted on, at most, and their features together.
FIT_ROWS = 6_000
FIT_FEATURES = 8_000_000
#: Labels of at most so many rows are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 500_000
EPOCHS = 12


_DIGIT, _MARK = np.zeros(256, np.int64), np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


class Model(NamedTuple):
    """Weight and squared log-count ratio of each feature; the score is logistic(slope * margin)."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct feature of each row, ordered by row."""
    rows, mask = w.last - w.first, np.uint64((1 << BITS) - 1)
    pair = w.row[1:] == w.row[:-1]
    two = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[pair]
    n = np.diff(w.bounds)
    size = np.bincount(w.row, w.end - w.start, rows)
    per_row = lambda table: np.bincount(w.row, np.diff(np.concatenate([[0], np.cumsum(table[w.data])])[np.stack([w.start, w.end])], axis=0)[0], rows)
    digits, marks = per_row(_DIGIT), per_row(_MARK)
    ones = np.unique((w.row.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    varied = np.bincount((ones >> np.uint64(40)).astype(np.int64), minlength=rows)
    total, chars = np.maximum(n, 1), np.maximum(size, 1)
    forms = [
        np.minimum(np.log2(total), 15), np.minimum(size / total, 20), 20 * varied / total,
        np.minimum(100 * digits / chars, 30), np.minimum(100 * marks / chars, 40),
    ]
    row = [w.row, w.row[1:][pair]] + [np.arange(rows)] * len(forms)
    code = [w.hash & mask, two & mask] + [mix(np.full(rows, 7919 * (i + 1), np.uint64) + x.astype(np.uint64)) & mask for i, x in enumerate(forms)]
    key = np.unique((np.concatenate(row).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(code))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & mask).astype(np.int64)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and _id is not null").distinct()
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    small = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return plain.join(F.broadcast(marks) if small else marks, "_id")


def _ratio_counts(rows: DataFrame) -> DataFrame:
    """Documents with each feature by label; feature -1: documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            label = np.asarray(batch.column(1), np.int64)
            for w in words(batch.column(0)):
                row, code = features(w)
                own = label[w.first : w.last]
                for k in (0, 1):
                    counts[k, 1:] += np.bincount(code[own[row] == k], minlength=1 << BITS)
                    counts[k, 0] += int((own == k).sum())
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "n0", "n1"])

    return rows.select("_text", "_label").mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _feature_rows(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0)):
                row, code = features(w)
                bounds = np.searchsorted(row, np.arange(w.last - w.first + 1))
                codes = pa.array([code[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([codes, *[batch.column(i).slice(w.first, w.last - w.first) for i in (1, 2)]], names=["codes", "label", "place"])

    return rows.select("_text", "_label", "_place").mapInArrow(cut, "codes binary, label int, place long")


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: float, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss linear model; y is -1 or 1."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, cost: float = 1.0) -> Model | None:
    """The model from all labelled rows of docs (ratios) and fit_rows of them (hinge loss); None without both classes."""
    bound_batches(docs.sparkSession)
    rows = _labelled(docs, labels, doc_id, text, label)
    counts = stash(_ratio_counts(rows)).toArrow()  # 2**BITS + 1 rows at most
    at = counts.column("feature").to_numpy() + 1
    n = np.zeros((2, (1 << BITS) + 1))
    n[0, at], n[1, at] = counts.column("n0").to_numpy(), counts.column("n1").to_numpy()
    if not n[0, 0] or not n[1, 0]:
        return None
    ratio = (np.log((n[1, 1:] + 1) / (n[1, 0] + 2)) - np.log((n[0, 1:] + 1) / (n[0, 0] + 2))).astype(np.float32)
    placed = rows.withColumn("_place", F.xxhash64("_id"))
    last = column(placed.select("_place").orderBy("_place").limit(fit_rows))[-1]
    chosen = stash(_feature_rows(placed.where(F.col("_place") <= int(last))))
    sizes = sorted((r["place"], r["size"]) for r in chosen.select("place", (F.octet_length("codes") / 4).cast("long").alias("size")).collect())  # fit_rows numbers, and those of repeated ids
    kept = np.cumsum([size for _, size in sizes]) <= FIT_FEATURES
    last = sizes[max(0, int(kept.sum()) - 1)][0]
    ratios = docs.sparkSession.sparkContext.broadcast(ratio)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("place", "ascending"), ("codes", "ascending"), ("label", "ascending")])
        weights, bias, slope = _fitted([np.frombuffer(x.as_buffer(), np.int32) for c in table.column("codes").chunks for x in c], np.where(table.column("label").to_numpy() == 1, 1.0, -1.0), ratios.value, cost)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias]), pa.array([slope])], names=["weights", "bias", "slope"])

    # one task: the sample is bounded in rows and features
    best = chosen.where(F.col("place") <= last).coalesce(1).mapInArrow(descend, "weights binary, bias double, slope double").first()
    return Model(np.frombuffer(best["weights"], np.float32) * ratio, ratio * ratio, best["bias"], best["slope"])


def _fitted(codes: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of the logistic curve from the features and labels of the sample."""
    values = [ratio[c].astype(np.float64) for c in codes]
    values = [v / max(1e-9, float(np.sqrt(v @ v))) for v in values]
    # the last fifth, left out of a first fit, tells where the margin divides the classes
    cut = len(y) - len(y) // 5
    slope, shift = 2.0, 0.0
    if len(y) >= 200 and len(set(y[:cut])) == 2 and len(set(y[cut:])) == 2:
        w, b = dual_coordinate_descent(codes[:cut], values[:cut], y[:cut], len(ratio), cost)
        slope, shift = _logistic(np.array([w[c] @ v + b for c, v in zip(codes[cut:], values[cut:], strict=True)]), y[cut:])
    w, b = dual_coordinate_descent(codes, values, y, len(ratio), cost)
    return w, b + shift / slope, slope


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over margin, by Newton steps."""
    a, b, t = 2.0, 0.0, (y > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-2 * (a - 2), (p - t).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0.05 else (2.0, 0.0)


def margins(w: Words, m: Model) -> np.ndarray:
    row, code = features(w)
    rows = w.last - w.first
    norm = np.sqrt(np.bincount(row, m.squares[code], rows))
    return np.bincount(row, m.weights[code], rows) / np.maximum(norm, 1e-9) + m.bias


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            margin = np.concatenate([np.zeros(0), *[margins(w, m) for w in words(texts)]])
            yield pa.array(1 / (1 + np.exp(-np.clip(m.slope * margin, -30, 30))))

    return docs.withColumn(out, probability(F.col(text)))
