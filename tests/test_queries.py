"""Every query against its SQL in DuckDB, over the small tables."""

import duckdb
import pytest

from gridloom import queries

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.7g}"
    return f"{float(value):.7g}" if hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    rows = queries.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    assert got
    if name in queries.oracle_sql():
        found = duck.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
