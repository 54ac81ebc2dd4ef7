"""Every query with SQL gives DuckDB's rows."""

import decimal

import duckdb
import pytest

from sigilo.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{float(v):.9g}" if isinstance(v, float | decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    if name not in SQL:
        return
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in out.fetchall())
