"""Every registered analysis with an oracle: Spark result == DuckDB result
(row count, column names, order-insensitive hash of all values)."""

import pytest

from tests.conftest import SF_MID, SF_SMALL

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tools.oracle_check import TABLES, digest  # noqa: E402

KEYS = sorted(oracle_sql())


#: their SQL states the p-value of samples above ``drift.KS_EXACT`` rows, so they need more rows
#: (exact p-values are held against enumeration in test_edge_cases)
LARGER = {"drift_ks", "drift_report"}


@pytest.fixture(scope="module")
def con():
    cons = {}
    for sf in (SF_SMALL, SF_MID):
        cons[sf] = duckdb.connect()
        for t in TABLES:
            cons[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return cons


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sf = SF_MID if key in LARGER else SF_SMALL
    df = queries()[key](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = con[sf].execute(oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_a_builder():
    q = queries()
    assert set(oracle_sql()) <= set(q)
    assert len(q) >= 80


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "profitability" in df.columns
