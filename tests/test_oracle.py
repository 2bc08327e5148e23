"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = [n for n in __spark_entry__.registry.QUERIES if n in __spark_entry__.registry.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{SF}/events.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_every_query_has_sql():
    assert set(OWN) == set(__spark_entry__.registry.QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
