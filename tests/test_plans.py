"""Physical-plan checks: the shapes the design relies on."""

import re

import pytest

from carepulse.config import FIXTURE
from carepulse.plans import advanced, explore, operations, revenue


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("fn", [explore.e02_null_audit, explore.e04_range_audit,
                                explore.e01_row_audit])
def test_audits_scan_once(adm01, fn):
    p = plan(fn(adm01, FIXTURE))
    assert p.count("FileScan parquet") == 1


def test_column_pruning_reaches_scan(adm01):
    p = plan(explore.e06_gender_dist(adm01, FIXTURE))
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert scan == "struct<gender:string>"


def test_top_n_is_take_ordered(adm01):
    assert "TakeOrderedAndProject" in plan(revenue.r04_hospital_top10(adm01, FIXTURE))


def test_top_k_per_group_uses_window_group_limit(adm01):
    assert "WindowGroupLimit" in plan(advanced.a09_topk_insurer_per_condition(adm01, FIXTURE))


def test_partial_aggregation_before_shuffle(adm01):
    p = plan(explore.e08_condition_counts(adm01, FIXTURE))
    assert "partial_count" in p


@pytest.mark.parametrize("fn", [operations.o06_long_stay_patients, advanced.a05_patient_risk])
def test_rows_are_not_moved_to_a_small_aggregate(spark, adm01, fn):
    """Also where Spark would not broadcast by itself: no Exchange above the scan."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        p = plan(fn(adm01, FIXTURE))
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
        # the fact is the first scan; what lies above it has no exchange
        above = p[:p.index("FileScan parquet")]
        assert "Exchange hashpartitioning" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_duplicate_audit_moves_doubled_rows_only(adm01):
    p = plan(explore.e11_full_duplicate_audit(adm01, FIXTURE))
    below = p[p.rindex("Exchange hashpartitioning"):]       # the exchange next to the scan
    assert "BroadcastHashJoin" in below and "LeftSemi" in below


def test_a_join_above_the_bound_is_salted(spark):
    from carepulse.operators.joins import SALTS, join_counted
    fact = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, NULL, CAST(id % 7 AS INT)) AS k", "'x' AS s")
    side = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b"), (9, "z")], "k int, v string")
    for how in ("inner", "left", "left_semi"):
        a = join_counted(fact, side, ["k"], how)
        b = join_counted(fact, side, ["k"], how, bound=0)
        assert "BroadcastHashJoin" in plan(a)
        assert f"pmod(xxhash64(id" in plan(b) and str(SALTS) in plan(b)
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.columns == b.columns
        assert a.count() == {"inner": 1000 + 2 * 286, "left": 3000, "left_semi": 1000 + 2 * 286}[how] or how != "left"


def test_patient_risk_rank_has_no_per_row_window(adm01):
    p = final_plan(advanced.a05_patient_risk(adm01, FIXTURE))
    # windows run over the per-score counts only: the rows are scanned and joined
    rows = [ln for ln in p.splitlines() if "Window [" in ln]
    assert all("_c#" in ln or "_n#" in ln for ln in rows)


@pytest.mark.parametrize("entities", [10, 200_000])
def test_ranking_has_one_plan_at_every_size(spark, entities):
    from carepulse.operators.ranking import rank_all
    df = spark.range(entities).selectExpr("id", "id % 97 AS v")
    out = rank_all(df, [("v", True)], ["id"], rank="r", ntile=(4, "q"), percent_rank="p")
    nodes = re.findall(r"[:+ ]*- (?:\*\(\d+\) )?(Window|Sort|Exchange \w+|BroadcastExchange)", plan(out))
    # windows run over the partitions' counts only (both uses of the numbered
    # rows); the rows themselves were placed by the checkpointed range sort
    assert nodes.count("Window") <= 4
    assert not any(n == "Exchange rangepartitioning" for n in nodes)
    assert out.where("q not between 1 and 4 or r < 1 or p < 0 or p > 1").count() == 0


def executions(spark, call, whole: bool = False) -> list[str]:
    """The physical plans of all executions that a call and its result start,
    those of eager checkpoints included: the final trees, or ``whole``, all text."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    wait(30_000)

    def listed() -> dict:        # the store keeps the last thousand only
        runs = store.executionsList()
        return {runs.apply(i).executionId(): runs.apply(i) for i in range(runs.size())}
    last = max(listed(), default=-1)
    call().collect()
    wait(30_000)
    plans = [r.physicalPlanDescription() for k, r in sorted(listed().items()) if k > last]
    return plans if whole else [p.split("== Initial Plan ==")[0].split("\n\n")[0] for p in plans]


def fact_scans(spark, call) -> int:
    return sum(len(re.findall(r"Scan parquet +\(\d+\)", t)) for t in executions(spark, call))


def range_shuffles(spark, monkeypatch, call) -> tuple[int, int]:
    """Range shuffles and checkpoints that a call takes."""
    from pyspark.sql import DataFrame
    n = {"range": 0, "checkpoint": 0}
    kind = type(spark.range(0))
    for name, key in (("repartitionByRange", "range"), ("checkpoint", "checkpoint")):
        def counted(self, *a, _f=getattr(kind, name), _k=key, **b) -> DataFrame:
            n[_k] += 1
            return _f(self, *a, **b)
        monkeypatch.setattr(kind, name, counted)
    call().collect()
    return n["range"], n["checkpoint"]


@pytest.mark.parametrize("key,most", [
    ("a03_doctor_scorecard", (1, 1)), ("a02_hospital_tiers", (1, 1)), ("o10_top_bottom_performers", (1, 1)),
    ("d05_hospital_rank_sliced", (1, 1)), ("d06_doctor_rank_sliced", (1, 1)), ("r08_hospital_quartiles", (1, 1)),
    ("a05_patient_risk", (0, 1))])
def test_all_orders_share_one_range_shuffle(spark, adm01, monkeypatch, key, most):
    from carepulse.plans.registry import ALL
    got = range_shuffles(spark, monkeypatch, lambda: ALL[key](adm01, FIXTURE))
    assert got[0] <= most[0] and got[1] <= most[1], got


# r01 and b01: one scan for the sketch, one for the exact ranks
@pytest.mark.parametrize("key,most", [
    ("o01_doctor_benchmark", 1), ("a06_executive_summary", 1), ("r12_monthly_calendar_mom", 1),
    ("d04_variance_vs_network", 1), ("o03_room_utilization", 1), ("o11_gap_to_network", 1),
    ("o04_revenue_per_day_hospital", 1), ("a03_doctor_scorecard", 1), ("r08_hospital_quartiles", 1),
    ("a05_patient_risk", 2), ("o06_long_stay_patients", 2), ("o10_top_bottom_performers", 1),
    ("e11_full_duplicate_audit", 2), ("r01_billing_kpis", 3), ("b01_los_overall", 3)])
def test_scans_of_the_fact(spark, adm01, key, most):
    """Counted over all jobs that the analysis starts."""
    from carepulse.plans.registry import ALL
    assert 1 <= fact_scans(spark, lambda: ALL[key](adm01, FIXTURE)) <= most


@pytest.mark.parametrize("key", ["a06_executive_summary", "r13_matrix_totals", "o07_emergency_rate",
                                 "o08_test_outcome_stack", "e01_row_audit"])
def test_expand_only_above_an_aggregate(adm01, key):
    from carepulse.plans.registry import ALL
    lines = plan(ALL[key](adm01, FIXTURE)).splitlines()
    for i, ln in enumerate(lines):
        if "Expand [" in ln:
            assert any("HashAggregate" in x for x in lines[i + 1:])


def test_review_check_reads_events_once(spark):
    from carepulse.streaming.intake import review_check
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert final_plan(review_check(ev, FIXTURE)).count("FileScan parquet") == 1
