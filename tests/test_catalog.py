"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from tallyloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    own = duckdb.connect()
    for f in os.listdir(DATA):
        own.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return own


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert normal(got.collect(), got.columns) == normal(rows, columns)
