"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

from winnowry import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def told(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(list(map(told, r))) for r in cur.fetchall())
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(list(map(told, r))) for r in got.select(*names).collect()) == want
