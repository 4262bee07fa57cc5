"""Approximate variants and parameters: close to the exact results."""

from carepulse.config import FIXTURE
from carepulse.plans import behaviour, explore, revenue


def test_approx_distinct_close_to_exact(adm01):
    exact = explore.e01_row_audit(adm01, FIXTURE).first()
    approx = explore.e01_row_audit(adm01, FIXTURE.with_(approx_distinct=True)).first()
    for c in ("distinct_hospitals", "distinct_doctors", "distinct_conditions", "distinct_insurers"):
        assert abs(approx[c] - exact[c]) <= 0.05 * exact[c] + 1


def test_percentile_accuracy_switch(adm01):
    exact = revenue.r01_billing_kpis(adm01, FIXTURE).first()
    approx = revenue.r01_billing_kpis(adm01, FIXTURE.with_(percentile_accuracy=10000)).first()
    for c in ("median_billing", "p25_billing", "p75_billing"):
        assert abs(approx[c] - exact[c]) <= 0.01 * exact[c]
    b = behaviour.b01_los_overall(adm01, FIXTURE.with_(percentile_accuracy=10000)).first()
    assert abs(b["median_los"] - behaviour.b01_los_overall(adm01, FIXTURE).first()["median_los"]) <= 1


def test_parameters_move_results(adm01):
    # a lower top cut puts more admissions into the high-value cohort
    base = revenue.r07_high_value_cohort(adm01, FIXTURE).first()["cohort_patients"]
    lower = revenue.r07_high_value_cohort(
        adm01, FIXTURE.with_(billing_cuts=(10_000, 20_000, 40_000))).first()["cohort_patients"]
    assert lower > base


def test_chi_square_matches_ml_chisquaretest(adm01):
    """b10's statistic against Spark ML's ChiSquareTest on the same table."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = StringIndexer(inputCols=["medical_condition", "medication"],
                       outputCols=["label", "med_idx"]).fit(adm01).transform(adm01)
    df = VectorAssembler(inputCols=["med_idx"], outputCol="features").transform(df)
    ml = ChiSquareTest.test(df, "features", "label").first()
    ours = behaviour.b10_medication_independence(adm01, FIXTURE).first()
    assert abs(ml["statistics"][0] - ours["chi2_stat"]) < 1e-3
    assert ml["degreesOfFreedom"][0] == ours["degrees_of_freedom"]


def test_medication_outcome_chi_square_parts_match_ml(adm01):
    """The per-medication parts of b12 add up to Spark ML's statistic for the
    medication x test-result table."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = StringIndexer(inputCols=["test_results", "medication"],
                       outputCols=["label", "med_idx"]).fit(adm01).transform(adm01)
    df = VectorAssembler(inputCols=["med_idx"], outputCol="features").transform(df)
    ml = ChiSquareTest.test(df, "features", "label").first()["statistics"][0]
    parts = sum(r["chi2_part"] for r in behaviour.b12_medication_outcomes(adm01, FIXTURE).collect())
    assert abs(parts - ml) < 1e-3
