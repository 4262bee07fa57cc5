"""Patient behaviour: length of stay, seasonality, medication, outcomes (b01-b15).

Cross-tab analyses (medication x condition, medication x outcome) aggregate
the rows into cells first; the cells are bounded by the product of two
categorical domains, so the windows over them are small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators.quantiles import percentiles
from ..operators.shares import distribution, grand


def b01_los_overall(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Average, minimum, maximum and median length of stay: one scan for all but
    the median, whose exact rank takes a second one."""
    q = percentiles(adm, "length_of_stay", {"median_los": 0.5}, cfg, summary=True)
    return q.select(X.rhu(X.safe_div("_sum", "_n"), 2).alias("avg_los"),
                    F.col("_min").cast("long").alias("min_los"),
                    F.col("_max").cast("long").alias("max_los"),
                    X.rhu("median_los", 2).alias("median_los"))


def b02_los_by_condition(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Average length of stay per condition."""
    return adm.groupBy("medical_condition").agg(
        F.count(F.lit(1)).alias("total_patients"), X.rhu(X.avg_exact(F.col("length_of_stay")), 2).alias("avg_los"))


def b03_los_by_admission_type(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Average length of stay and billing per admission type."""
    return adm.groupBy("admission_type").agg(
        F.count(F.lit(1)).alias("total_patients"), X.rhu(X.avg_exact(F.col("length_of_stay")), 2).alias("avg_los"),
        X.rhu(X.avg_exact(F.col("billing_amount")), 2).alias("avg_billing"))


def b04_los_tiers(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per length-of-stay tier with share and average billing."""
    return distribution(adm, X.los_tier("length_of_stay", cfg), "los_tier",
                        extra={"avg_billing": X.rhu(X.avg_exact(F.col("billing_amount")), 2)})


def b05_seasonal(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per season with share and the average per year the season occurs in."""
    d = distribution(adm, X.season(), "season",
                     extra={"years_present": F.countDistinct(F.year("date_of_admission"))})
    return d.withColumn("avg_per_year", X.rhu(X.safe_div("total_patients", "years_present"), 1))


def b06_month_of_year(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per calendar month with a rolling average over the preceding months (the
    series is bounded by the calendar)."""
    g = adm.groupBy(F.year("date_of_admission").cast("long").alias("admission_year"),
                    F.month("date_of_admission").cast("long").alias("admission_month")).agg(
        F.count(F.lit(1)).alias("total_patients"))
    k = cfg.rolling_months
    w = Window.orderBy("admission_year", "admission_month").rowsBetween(-(k - 1), 0)
    return g.withColumn("rolling_avg_3m", X.rhu(
        X.safe_div(F.sum("total_patients").over(w), F.count("total_patients").over(w)), 2))


def b07_day_of_week(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per day of the week with share and average billing."""
    d = distribution(adm, X.day_name(), "day_of_week",
                     extra={"day_number": F.min(F.dayofweek("date_of_admission")).cast("long"),
                            "avg_billing": X.rhu(X.avg_exact(F.col("billing_amount")), 2)})
    return d


def medication_cells(adm: DataFrame) -> DataFrame:
    """Admissions per condition x medication cell."""
    return adm.groupBy("medical_condition", "medication").agg(
        F.count(F.lit(1)).alias("total_patients"))


def b08_medication_by_condition(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Medication mix within each condition (share of the condition's admissions)."""
    c = medication_cells(adm)
    w = Window.partitionBy("medical_condition")
    return c.withColumn("pct_in_condition",
                        X.pct("total_patients", F.sum("total_patients").over(w), 1))


def b09_medication_dominance(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Most prescribed medication per condition and whether its share exceeds
    the dominance limit (22% in the reference)."""
    c = medication_cells(adm)
    w = Window.partitionBy("medical_condition")
    c = c.withColumn("_share", F.col("total_patients") * 100.0
                     / F.sum("total_patients").over(w))
    top = c.withColumn("_rn", F.row_number().over(
        w.orderBy(F.col("total_patients").desc(), F.col("medication")))).filter("_rn = 1")
    return top.select("medical_condition", F.col("medication").alias("top_medication"),
                      X.rhu("_share", 1).alias("top_share_pct"),
                      (F.col("_share") > cfg.dominance_limit_pct).alias("over_limit"))


def chi_square_cells(cells: DataFrame, row: str, col: str, count: str) -> DataFrame:
    """Per-cell chi-square terms without materialising empty cells:
    sum over all cells of (o - e)^2 / e = sum over observed cells of o^2 / e - n."""
    wr, wc = Window.partitionBy(row), Window.partitionBy(col)
    c = (cells.withColumn("_r", F.sum(count).over(wr))
              .withColumn("_c", F.sum(count).over(wc)))
    c = c.withColumn("_n", grand(count))
    c = c.withColumns({"_rows": F.size(F.collect_set(row).over(Window.partitionBy())),
                       "_cols": F.size(F.collect_set(col).over(Window.partitionBy()))})
    return c.withColumn("_term", F.col(count).cast("double") * F.col(count) * F.col("_n")
                        / (F.col("_r").cast("double") * F.col("_c")))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-square with ``df`` degrees of freedom, rounded to 4 digits:
    the regularised incomplete gamma function Q(df/2, x/2).  NULL for df <= 0."""
    return F.when(df > 0, X.rhu(X.gamma_q(df / 2, x / 2), 4))


def b10_medication_independence(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Chi-square test of condition x medication independence."""
    c = chi_square_cells(medication_cells(adm), "medical_condition", "medication",
                         "total_patients")
    one = c.groupBy("_n", "_rows", "_cols").agg(F.sum("_term").alias("_s"))
    chi2 = F.col("_s") - F.col("_n")
    one = one.withColumns({"_chi2": chi2, "_df": (F.col("_rows") - 1) * (F.col("_cols") - 1)})
    return one.select(
        X.rhu(chi2, 4).alias("chi2_stat"), chi_square_tail(F.col("_chi2"), F.col("_df")).alias("p_value"),
        ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("long").alias("degrees_of_freedom"),
        F.col("_n").cast("long").alias("total_observations"),
        X.rhu(F.sqrt(F.try_divide(chi2, F.col("_n") * (F.least("_rows", "_cols") - 1))), 4)
        .alias("cramers_v"))


def outcome_rates(adm: DataFrame, key, name: str | None = None) -> DataFrame:
    """Normal / abnormal / inconclusive rates per value of ``key`` (conditional counts, one
    pass)."""
    k = X.col(key)
    if name:
        k = k.alias(name)
    n = F.count(F.lit(1))
    r = F.col("test_results")
    return adm.groupBy(k).agg(
        n.alias("total_patients"),
        X.pct(F.count_if(r == "Normal"), n, 1).alias("normal_rate"),
        X.pct(F.count_if(r == "Abnormal"), n, 1).alias("abnormal_rate"),
        X.pct(F.count_if(r == "Inconclusive"), n, 1).alias("inconclusive_rate"))


def b11_outcome_by_age_group(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Test-result rates per age group."""
    return outcome_rates(adm, X.age_group("age"), "age_group")


def b12_medication_outcomes(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Normal rate per medication, its difference from the overall normal rate,
    the medication's share of the medication x outcome chi-square and, from it,
    the p-value of its results against the overall mix (outcomes - 1 degrees)."""
    cells = adm.groupBy("medication", "test_results").agg(F.count(F.lit(1)).alias("_o"))
    c = chi_square_cells(cells, "medication", "test_results", "_o")
    c = c.withColumn("_normal", F.when(F.col("test_results") == "Normal", F.col("_o")))
    g = c.groupBy("medication").agg(
        F.first("_r").alias("total_patients"), F.first("_n").alias("_n"), F.first("_cols").alias("_k"),
        F.coalesce(F.sum("_normal"), F.lit(0)).alias("_nm"),
        F.sum("_term").alias("_s"))
    g = g.withColumn("_na", grand("_nm"))
    rate = F.col("_nm").cast("double") * 100.0 / F.col("total_patients")
    overall = F.col("_na").cast("double") * 100.0 / F.col("_n")
    return g.select("medication", F.col("total_patients").cast("long").alias("total_patients"),
                    X.rhu(rate, 1).alias("normal_rate"),
                    X.rhu(rate - overall, 2).alias("diff_vs_overall"),
                    X.rhu(F.col("_s") - F.col("total_patients"), 4).alias("chi2_part"),
                    chi_square_tail(F.col("_s") - F.col("total_patients"), F.col("_k") - 1).alias("p_value"))


def b13_condition_outcomes(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Test-result rates per condition and whether the normal rate exceeds the limit (35% in
    the reference)."""
    o = outcome_rates(adm, "medical_condition")
    return o.withColumn("normal_above_limit", F.col("normal_rate") > cfg.normal_rate_limit_pct)


def b14_abnormal_billing(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Billing of abnormal vs other results per condition and their correlation."""
    ab = F.col("test_results") == "Abnormal"
    return adm.groupBy("medical_condition").agg(
        X.rhu(X.avg_exact(F.when(ab, F.col("billing_amount"))), 2).alias("avg_billing_abnormal"),
        X.rhu(X.avg_exact(F.when(~ab | F.col("test_results").isNull(), F.col("billing_amount"))), 2)
        .alias("avg_billing_other"),
        X.rhu(F.corr(F.when(ab, 1.0).otherwise(0.0), F.col("billing_amount").cast("double")), 4)
        .alias("abnormal_billing_corr"))


def b15_outcome_mix(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Share of each test result."""
    return distribution(adm, "test_results")


def b16_medication_normal_test(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Whether a medication's normal-result rate differs from that of all others:
    a chi-square test of the 2 x 2 table (one degree of freedom) per medication."""
    g = adm.groupBy("medication").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("test_results") == "Normal").alias("_m"))
    g = g.withColumns({"_an": grand("_n").cast("double"), "_am": grand("_m").cast("double")})
    n, m, an, am = (F.col(c) for c in ("_n", "_m", "_an", "_am"))
    cross = m * (an - n - am + m) - (n - m) * (am - m)
    chi2 = F.try_divide(an * cross * cross, n.cast("double") * (an - n) * am * (an - am))
    p = F.when(chi2.isNotNull(), chi_square_tail(chi2, F.lit(1)))
    return g.select(
        "medication", n.alias("total_patients"), X.pct("_m", "_n", 1).alias("normal_rate"),
        X.rhu(F.try_divide((am - m) * 100.0, an - n), 1).alias("other_normal_rate"),
        X.rhu(chi2, 4).alias("chi2_stat"), p.alias("p_value"),
        F.coalesce(p < cfg.significance, F.lit(False)).alias("significant"))
