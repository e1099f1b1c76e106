"""Every named query of the library against its SQL on DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from lodestone.catalog import ORACLE, QUERIES


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, decimal.Decimal):
        return float(x)
    return tuple(plain(y) for y in x) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns and len(rows) >= 0
        return
    want = duck.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert mine == theirs
