"""Every registered query of the retrieval engine against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tessera import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if v is None or isinstance(v, (int, str)):
        return v
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.sql(sql)
    place = [result.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())
    assert sorted(result.columns) == names
    assert got == want
