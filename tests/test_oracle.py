"""Every registered query against its independent DuckDB oracle at sf0.01
(the driver's correctness gate, reproduced locally)."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_compare import compare

KEYS = sorted(entry.ANALYSES)


def test_every_analysis_is_registered_with_an_oracle():
    assert set(KEYS) <= set(entry.queries()) and set(KEYS) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(KEYS) >= 60


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck01, key):
    res = compare(spark, SF01, [key], con=duck01, verbose=False)[key]
    assert res["ok"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["month", "monthly_revenue", "running_total", "mom_growth_pct"]
