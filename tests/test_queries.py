"""Every registered query against its check SQL on the smallest driver tables."""

from pathlib import Path

import pytest

from codelens_spark.registry import ORACLES, QUERIES
from tools.check import TABLES, rows

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, rel.fetchall()) and got
