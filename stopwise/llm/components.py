"""Connected components of a table of links: each task contracts its links, then small-star and large-star steps alternate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Only a guard against loops without end; passing it is an error.
MOST_STEPS = 1_000_000
#: Links that a task contracts at once.
LINKS = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is not the least of its component, and the least."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while (unlike := root[a] != root[b]).any():
        x, y = root[a[unlike]], root[b[unlike]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(links: DataFrame) -> DataFrame:
    """Stars (u, v) of the components of what each task holds of the links, at most as many rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sides = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*sides)], names=["u", "v"])

        for batch in batches:
            held.append([np.asarray(batch.column(i), np.int64) for i in (0, 1)])
            size += batch.num_rows
            if size >= LINKS:
                yield out()
                held, size = [], 0
        yield out()

    return links.mapInArrow(each, "u long, v long")


def _small_star(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v: each u keeps its least neighbour below, the others get a link to that."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v: each v is replaced by its own least neighbour below, if it has one."""
    least = links.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return links.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _finished(links: DataFrame) -> bool:
    """Whether each u has one v, which is no u."""
    ends = links.select(F.col("u").alias("node"), "v").unionByName(links.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v").isNull()).alias("below"))
    return seen.agg(F.count_if((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & F.col("below")))).first()[0] == 0


def star_components(edges: DataFrame) -> DataFrame:
    """From links (u, v): each u that is not the smallest of its component, with the smallest as v.

    Links of a node with itself and nulls are ignored; a hub's links are
    combined before each shuffle, so no task holds a component.  Links that tasks
    make in Python should be written first: each task would have two workers.
    """
    now = stash(_contracted(edges.select("u", "v").where("u <> v")))
    for step in range(MOST_STEPS):
        if _finished(now):
            # a star may have come from several tasks
            return now if step else now.distinct()
        now = stash(_large_star(_small_star(now)).distinct())
    raise RuntimeError(f"links still change after {MOST_STEPS} steps")
