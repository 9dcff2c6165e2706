"""Each query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from symdex.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    r = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns) == _rows(r.fetchall(), names)
