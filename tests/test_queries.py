"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quirelake import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    there = duck.sql(plans.oracle_sql()[name])
    assert columns == sorted(there.columns)
    want = sorted(repr(tuple(r)) for r in there.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def test_all_but_the_sequential_have_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"leader_clusters"}
