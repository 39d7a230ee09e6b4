"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES
