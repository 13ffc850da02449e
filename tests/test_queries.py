"""Every query with SQL against DuckDB on the small tables; the others run and give rows."""

import glob
import math
import os

import duckdb
import pytest

from strandmill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == columns
    want = plain(db.sql(f"SELECT {', '.join(columns)} FROM rel").fetchall())
    assert got == want
