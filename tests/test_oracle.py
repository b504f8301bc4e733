"""Every query with SQL against DuckDB on the same tables; the others give rows."""

import collections
import decimal
import math

import duckdb
import pytest

from stratafind import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    assert not any(kind == "void" for _, kind in df.dtypes)
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
    else:
        assert df.count() > 0
