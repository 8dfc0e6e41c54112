"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from stopwise import queries as transit

transit.register()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(transit.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, duck, name):
    assert rows_of(transit.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(transit.ORACLE_SQL[name]).df())
