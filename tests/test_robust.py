"""Every analysis runs without error on awkward inputs: an empty table, and a
small table mixing NULLs in every column, negative and zero stays, zero and
negative billing, one hospital, one condition."""


import pytest
from pyspark.sql import functions as F

from carepulse.config import DEFAULTS
from carepulse.plans.registry import ANALYSES
from test_golden import D, adm, row

KEYS = sorted(ANALYSES)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [row(), row(name="n", admit=D(2021, 3, 1), discharge=D(2021, 2, 1)),
            row(name="z", los=0, billing="0.00"), row(name="neg", billing="-10.00", age=-3),
            row(name="big", age=200, billing="999999.99", atype="Emergency", result="Abnormal"),
            (None,) * 15, row(name="nulls", age=None, doctor=None, hospital=None, result=None,
                              atype=None, billing=None)]
    return adm(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return adm(spark, []).cache()


@pytest.mark.parametrize("key", KEYS)
def test_runs_on_awkward_and_empty_input(awkward, empty, key):
    ANALYSES[key](awkward, DEFAULTS).collect()
    ANALYSES[key](empty, DEFAULTS).collect()


def test_review_check_with_nulls(spark):
    from carepulse.streaming.intake import review_check
    rows = [(1, "2024-01-01 10:00:00", 1, "signup"), (2, "2024-01-01 11:00:00", 1, "view"),
            (3, None, 2, "signup"), (4, "2024-01-01 10:00:00", None, "signup"),
            (5, "2024-01-01 23:00:00", 3, "signup"), (6, "2024-01-02 01:30:00", 3, "view"),
            (7, "2024-01-02 05:00:00", 4, "signup"), (8, "2024-01-02 09:00:01", 4, "view")]
    ev = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string") \
        .withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {r["event_id"]: (r["reviewed"], r["minutes_to_review"])
           for r in review_check(ev, DEFAULTS).collect()}
    assert got == {1: (True, 60.0), 3: (False, None), 4: (False, None),
                   5: (True, 150.0), 7: (False, None)}
