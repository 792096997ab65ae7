"""Every registered query of the reference's operators against its SQL, over whole tables at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from vectorloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "tolist") and not hasattr(x, "isoformat"):
        x = x.tolist()
    return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    expected = db.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
