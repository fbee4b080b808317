"""Every query with an oracle gives its rows; the others give some."""

import os

import duckdb
import pytest

from tracelode.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v  # no signed zero


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    columns = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    places = [want.columns.index(c) for c in columns]
    key = repr
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=key)
