"""Every registered query against its DuckDB oracle (sf0.001); rows-only queries must run."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ledgerflow.plans.checks import compare, duck
from ledgerflow.plans.registry import load_all

from .conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(load_all()))  # those of the training-data operators are run in their own folder
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[name])
    msg = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert msg is None, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["account", "type", "total_debit", "total_credit"]
    assert df.count() >= 0
