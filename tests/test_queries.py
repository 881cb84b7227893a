"""Every query of the reference operators against its SQL in DuckDB, on the driver's smallest tables."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from intervalia.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", plans.QUERIES)
def test_same_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(plain(v) for v in r) for r in got.select(*cols).collect()) == want
