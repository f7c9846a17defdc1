"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fringeflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df())
    else:
        assert len(got)
