"""Every query with an SQL twin against DuckDB on the smallest tables; the others give rows and a stable schema."""

import os

import duckdb
import pytest

from scholium import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str([shown(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERY_SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.QUERY_SQL[name])
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(shown, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(shown, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.QUERY_SQL)))
def test_gives_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns and got.count() >= (name not in ("continued_tables", "table_text"))
