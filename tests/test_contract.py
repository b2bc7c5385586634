"""Every query of the driver's contract runs, and equals its SQL where it has one."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    if name in entry.oracle_sql():
        rel = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
        assert rows == want
    else:
        assert sum(rows.values()) > 0


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
