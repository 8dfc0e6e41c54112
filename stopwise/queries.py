"""The library's analyses bound to the synthetic tables, each with the DuckDB statement of the same rows.

to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import EPOCH, Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def r6(*columns: str) -> dict[str, Column]:
    """Columns rounded to six decimals."""
    return {c: F.round(F.col(c).cast("double"), 6) for c in columns}


def register() -> None:
    """Load the modules that hold the queries."""
    from .bindings import formats, network, reach, realtime, schedule, sources, space, streams, text, town  # noqa: F401


__all__ = ["EPOCH", "ORACLE_SQL", "QUERIES", "query", "r6", "register"]
