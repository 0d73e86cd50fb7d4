"""Every catalogued query against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from stratalake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    chosen = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(plain, r)) for r in duck.execute(f"SELECT {chosen} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
