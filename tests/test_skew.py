"""Skew: one hospital, one doctor (and so one condition) and one user hold a
third of all rows.  The analyses most exposed to hot keys (joins to
aggregates, rankings, top-n, duplicates, the review check) must still match
the oracle run on the same skewed tables."""

import tempfile

import duckdb
import pytest

from conftest import SF01
from oracle_compare import compare, duck

KEYS = ["o06_long_stay_patients", "a02_hospital_tiers", "a03_doctor_scorecard",
        "a05_patient_risk", "r04_hospital_top10", "o10_top_bottom_performers",
        "e03_duplicate_audit", "x2_review_deadline_check", "r01_billing_kpis",
        "o01_doctor_benchmark", "a06_executive_summary", "o07_emergency_rate",
        "d04_variance_vs_network", "b01_los_overall", "a09_topk_insurer_per_condition",
        "r08_hospital_quartiles"]


@pytest.fixture(scope="module")
def skew_dir():
    d = tempfile.mkdtemp(prefix="carepulse-skew-", dir="/tmp")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        src = f"{SF01}/{t}.parquet"
        if t == "events":
            q = (f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)"
                 f" FROM read_parquet('{src}')")
        else:
            q = f"SELECT * FROM read_parquet('{src}')"
        con.execute(f"COPY ({q}) TO '{d}/{t}.parquet' (FORMAT PARQUET)")
    con.execute(f"""COPY (SELECT * REPLACE (
            CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey,
            CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS l_partkey)
        FROM read_parquet('{SF01}/lineitem.parquet')) TO '{d}/lineitem.parquet' (FORMAT PARQUET)""")
    return d


def test_skewed_tables_are_skewed(skew_dir):
    n, hot = duckdb.connect().execute(f"SELECT COUNT(*), COUNT(*) FILTER (WHERE l_suppkey = 1) "
                        f"FROM read_parquet('{skew_dir}/lineitem.parquet')").fetchone()
    assert hot > n / 3 - 100


@pytest.mark.parametrize("key", KEYS)
def test_hot_keys_match_oracle(spark, skew_dir, key):
    res = compare(spark, skew_dir, [key], con=duck(skew_dir), verbose=False)[key]
    assert res["ok"], res
