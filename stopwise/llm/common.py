"""Helpers that several operators share: tables in the shared folder, word hashing.

Words are hashed from the Arrow buffers with NumPy, without a Python object per
word.  A word's hash is a polynomial over randomised byte values modulo 2**64,
finished by a mixing step; equal words have equal hashes on every executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once in a task; bounds the NumPy arrays.
CHUNK_BYTES = 600_000
#: Texts that travel to a Python worker at once; a text has no bound, so these are few.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

_RNG = np.random.default_rng(20240607)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C17)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stopwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stopwise-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES, which bounds the memory of workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame) -> np.ndarray:
    """The first column of df, of a bounded number of rows, without a Python object per value."""
    return df.select(df.columns[0]).toArrow().column(0).to_numpy()


def heaviest(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of counts (a written table with a column n): those with n over a threshold, found by a histogram instead of a sort."""
    # 64 powers of two in 8 parts each
    part = F.floor(8 * F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int")
    at, total = 1 << 30, 0
    for r in sorted(counts.groupBy(part.alias("part")).count().collect(), key=lambda r: -r["part"]):
        total += r["count"]
        if total > most:
            break
        at = r["part"]
    return counts.where(part >= at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finishing step on uint64 (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse; kept for the largest size so far."""
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        one = np.ones(1, np.uint64)
        have = tuple(np.cumprod(np.concatenate([one, np.full(size - 1, r, np.uint64)]), dtype=np.uint64) for r in (_R, _R_INV))
        _POWERS[0] = have
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal sequences have equal hashes wherever they lie."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Classes of bytes that are part of a word.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.ones(256, bool)
LETTERS_DIGITS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """The words of rows first..last of a batch; start and end are byte offsets into data."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of each word, counted from first
    hash: np.ndarray
    bounds: np.ndarray  # word index where each row's words begin; one more at the end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def words(texts: pa.Array, kind: np.ndarray = SPACE_SEPARATED, lower: bool = True, hashes: bool = True) -> Iterator[Words]:
    """Words of a string column, a bounded number of bytes at a time (one text at least)."""
    offsets, data = buffers(texts)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        lo, hi, rows = int(offsets[first]), int(offsets[last]), last - first
        part = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        inside = kind[part]
        row_end = offsets[first + 1 : last + 1] - lo
        # a word begins where the byte before is outside or of another text, and ends likewise
        before = np.zeros(hi - lo + 1, bool)
        before[1:] = inside
        before[row_end] = False
        start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(hi - lo + 1, bool)
        after[:-1] = inside
        after[row_end] = False
        end = np.flatnonzero(inside & ~after[1:]) + 1
        row = np.searchsorted(row_end, start, "right")
        bounds = np.searchsorted(row, np.arange(rows + 1))
        h = span_hash(_BYTE_VALUE[part], start, end) if hashes else np.zeros(0, np.uint64)
        yield Words(first, last, part, start, end, row, h, bounds)
        first = last


def windows(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of k words within a row; with short, a row of fewer words is one run."""
    n = len(w.row)
    at = np.arange(max(0, n - k + 1))
    at = at[w.row[at] == w.row[at + k - 1]] if n >= k else at[:0]
    hashes = span_hash(w.hash, at, at + k)
    if short:
        size = np.diff(w.bounds)
        few = np.flatnonzero((size > 0) & (size < k))
        at = np.concatenate([at, w.bounds[few]])
        hashes = np.concatenate([hashes, span_hash(w.hash, w.bounds[few], w.bounds[few + 1])])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    return at, hashes


def hash_bytes(word: bytes) -> int:
    """The hash that words() gives to this word."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hash(_BYTE_VALUE[data], np.array([0]), np.array([len(data)]))[0])
