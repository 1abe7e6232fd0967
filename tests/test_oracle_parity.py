"""Every registered job against its DuckDB oracle (the driver's gate, run
here on the small sf0.001 tables).  Jobs without an oracle must still run."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, rows_key

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(cols) == len(set(cols))
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(cols)
    order = [rel.columns.index(c) for c in cols]
    expect = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert len(rows) == len(expect)
    assert rows_key(rows) == rows_key(expect)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["order_year_month", "revenue", "previous_month_revenue", "mom_growth_percent"]
    assert df.count() > 0
