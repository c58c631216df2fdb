"""Every registered query against its DuckDB oracle on the smallest tables,
and every query without an oracle must at least run."""

import duckdb
import pytest

import __spark_entry__ as E
from postlens.tables import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    recs = [r.asDict(recursive=True) for r in df.collect()]
    if name not in ORACLES:
        assert isinstance(recs, list)
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    drecs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert rows_of(recs, cols) == rows_of(drecs, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "source" in df.columns
