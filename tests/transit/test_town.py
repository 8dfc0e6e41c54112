"""Queries of reach over all stops against their statements on the smallest tables."""

import duckdb
import pytest

from stopwise import queries
from stopwise.bindings import oracle, town

queries.register()


@pytest.mark.parametrize("name", sorted(town.SMALL_SQL))
def test_equals_its_statement(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("customer", "supplier", "lineitem", "nation", "events", "orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(oracle(town.SMALL_SQL[name]))
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, sf_dir).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_passes_and_shapes(spark, sf_dir):
    """Bikes and rail only add cells; a pass of one departure is the cells of its labels."""
    rows = {}
    for r in queries.QUERIES["graph_04_passes"](spark, sf_dir).collect():
        rows.setdefault(r["source"], {})[r["pass"]] = r["cells"]
    assert rows
    for each in rows.values():
        assert set(each) == {1, 2, 3, 4}
        assert each[1] <= each[2] <= each[3]
