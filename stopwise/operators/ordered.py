"""As-of joins, gaps and dominant values over ordered rows, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def next_at_or_after(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, out: str = "next", width: float | None = None) -> DataFrame:
    """left with the least right_time of its key that is not before left_time; one sort for both sides.

    Null if there is none, and where a key or left_time is null.  Where keys are few and
    rows many, ``width`` cuts the times of a key into spans of that length, which are
    sorted by tasks of their own; the least time of later spans is carried to each.
    """
    return _as_of(left, right, by, left_time, right_time, out, width, after=True)


def last_at_or_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, out: str = "previous", width: float | None = None) -> DataFrame:
    """left with the greatest right_time of its key that is not after left_time, else as ``next_at_or_after``."""
    return _as_of(left, right, by, left_time, right_time, out, width, after=False)


def _as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, out: str, width: float | None, after: bool) -> DataFrame:
    nearest = F.min if after else F.max
    a = left.withColumn("_t", F.col(left_time)).withColumn("_right", F.lit(None).cast(dict(right.dtypes)[right_time])).withColumn("_own", F.lit(True))
    b = right.dropna(subset=[*by, right_time]).select(*by, F.col(right_time).alias("_t"), F.col(right_time).alias("_right"), F.lit(False).alias("_own"))
    if width is not None:
        b = b.distinct()  # equal times are one before the shuffle
    both = a.unionByName(b, allowMissingColumns=True)
    keys = by
    if width is not None:
        both, keys = both.withColumn("_span", F.floor(F.col("_t") / width)), [*by, "_span"]
    w = W.partitionBy(*keys).orderBy("_t")
    met = both.withColumn(out, nearest("_right").over(w.rangeBetween(W.currentRow, W.unboundedFollowing) if after else w.rangeBetween(W.unboundedPreceding, W.currentRow))).where("_own")
    if width is not None:
        order = W.partitionBy(*by).orderBy("_span" if after else F.desc("_span")).rowsBetween(1, W.unboundedFollowing)
        spans = both.groupBy(*keys).agg(nearest("_right").alias("_r"))  # a row for each span
        met = met.join(spans.withColumn("_far", nearest("_r").over(order)).drop("_r"), keys, "left").withColumn(out, F.coalesce(out, "_far"))
    return met.withColumn(out, F.when(F.col("_t").isNotNull(), F.col(out))).select(*left.columns, out)


def gaps_of(df: DataFrame, by: list[str], time: str, out: str = "gap") -> DataFrame:
    """Rows with the time to the next row of their key; the last row of a key has none and is dropped."""
    w = W.partitionBy(*by).orderBy(time)
    return df.withColumn(out, F.lead(time).over(w) - F.col(time)).where(F.col(out).isNotNull())


def first_by(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def dominant(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equal counts the one seen first in order."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return first_by(counted, by, F.desc("n"), "_first").drop("_first")


def dense(df: DataFrame, by: list[str], slot: str, slots: int, values: list[str]) -> DataFrame:
    """One row for each key and slot from 0 to slots - 1; values that are missing become 0."""
    every = df.select(*by).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return every.join(df.withColumn(slot, F.col(slot).cast("int")), [*by, slot], "left").fillna(0, subset=values)


def ranked(df: DataFrame, *order: Column | str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in the order, within by."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*(by or [])).orderBy(*order)))
