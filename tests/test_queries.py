"""Every cube query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import more_queries  # noqa: F401
from gridloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(db.sql(ORACLE_SQL[name]).df())
