"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_TINY

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from reportlake.sources.tables import TABLES  # noqa: E402

from reportlake.plans.registry import all_queries  # noqa: E402

QUERIES = {k: v for k, v in E.queries().items() if k in all_queries()}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_is_registered_with_an_oracle_or_documented():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_TINY)
    srows, scols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    drows, dcols = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["zone_id", "severity", "start_value", "end_value", "change", "pct_change", "trend"]
