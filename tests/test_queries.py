"""Every registered query of the figure operators against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from rasterlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, SF)
    want = sql.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in got.collect())
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
