"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from facetwise import plans

REGISTERED = plans.registered()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return (float(f"{v:.9g}") if not math.isnan(v) else None) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(REGISTERED))
def test_matches_sql(spark, db, data, name):
    build, sql = REGISTERED[name]
    df = build(spark, data)
    rel = db.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    mine = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    at = [rel.columns.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert ordered(mine) == ordered(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
