"""Every query of the catalogue against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _key(row):
    return tuple((x is None, "n" if isinstance(x, (int, float)) else str(type(x)), str(x) if isinstance(x, (list, dict)) else x) for x in row)


def _rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: "nan" if isinstance(x, float) and x != x else x
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=_key)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
