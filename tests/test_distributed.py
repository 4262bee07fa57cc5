"""The ranking and percentile analyses give exactly the oracle's results with
another number of range partitions."""

import pytest

from carepulse.config import FIXTURE
from carepulse.plans.registry import ANALYSES
from carepulse.plans.oracle_sql import oracle_sql
from oracle_compare import canon

KEYS = ["a02_hospital_tiers", "a03_doctor_scorecard", "a05_patient_risk", "r08_hospital_quartiles",
        "r09_quartile_ratio", "o10_top_bottom_performers", "r01_billing_kpis", "b01_los_overall"]


@pytest.mark.parametrize("key", KEYS)
def test_distributed_matches_oracle(spark, duck01, adm01, key):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ANALYSES[key](adm01, FIXTURE).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    exp = duck01.execute(oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert canon(got) == canon(exp)
