"""Every named query runs on the smallest tables, and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__
from millrace.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    cell = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        columns = list(want.columns)
        assert sorted(df.columns) == sorted(columns)
        assert normal(rows, columns) == normal([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)
    assert df.columns and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(ORACLE) <= set(__spark_entry__.queries())
