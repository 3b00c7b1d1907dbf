"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from loci.plans.catalog import QUERIES, SQL, load_all

WITHOUT_SQL: set[str] = set()
FOLDER = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        # What SQL does not reach has to be listed, has rows, and none of them twice.
        assert name in WITHOUT_SQL and mine and len(mine) == len(set(mine))
        return
    rel = con.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
