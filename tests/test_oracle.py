"""Every query of the catalog that has SQL, against DuckDB on the same small tables."""

import math
import os

import pytest

from fieldtrace.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool | str):
        return str(x)
    return repr(round(float(x), 9))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    made = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in made.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    assert got == want
