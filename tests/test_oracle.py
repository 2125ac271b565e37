"""Every registered query against its DuckDB oracle on the driver tables."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as se
from huddle.plans.registry import QUERIES

SF_DIR = os.environ.get("HUDDLE_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["customer", "part", "lineitem", "events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables missing")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(se.queries()) and set(QUERIES) <= set(se.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = se.queries()[key](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(se.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["league_id", "team_name", "wins", "losses", "avg_pts"]
    assert df.count() > 0
