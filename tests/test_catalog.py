"""Every registered query of the operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert df.count() > 0
        return
    want = db.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda it: sorted(tuple(map(shown, r)) for r in it)
    assert rows(df.select(*[f"`{c}`" for c in want.columns]).collect()) == rows(want.fetchall())
