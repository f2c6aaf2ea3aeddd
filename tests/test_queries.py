"""Every query of the catalogue beside its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) and math.isfinite(value) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows is not None
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda cols: sorted(range(len(cols)), key=cols.__getitem__)
    a, b = order(df.columns), order(want.columns)
    assert sorted(tuple(plain(r[k]) for k in a) for r in rows) == sorted(tuple(plain(r[k]) for k in b) for r in want.fetchall())
