"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from spanloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")


def rows(df):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 6)

    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, db, name):
    got, expected = plans.queries()[name](spark, SF).toPandas(), db.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_flagship(spark):
    assert {r["annotation"] for r in plans.flagship(spark, SF).collect()} <= {"Promoter-TSS", "5UTR", "3UTR", "Exonic", "Intronic", "Intergenic"}
