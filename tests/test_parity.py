"""Every registered catalog query against its SQL twin in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from stacksight.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert got, "an empty result proves nothing"
    if key in SQL:
        cur = con.execute(SQL[key])
        at = [d[0] for d in cur.description]
        assert sorted(at) == names
        want = [tuple(plain(r[at.index(c)]) for c in names) for r in cur.fetchall()]
        assert ordered(got) == ordered(want)
