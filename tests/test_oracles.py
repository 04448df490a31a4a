"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tabulae import catalog

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
