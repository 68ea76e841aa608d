"""Every query that SQL can express gives the same rows in another engine."""

import glob
import os

import duckdb
import pytest

from paperloom.plans.oracle import ORACLE_SQL
from paperloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[k], 9) + 0.0 if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_all_queries_run(spark):
    for name in sorted({*QUERIES} - {*ORACLE_SQL}):
        assert QUERIES[name](spark, SF).count() > 0
