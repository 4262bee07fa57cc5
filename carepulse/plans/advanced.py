"""Advanced window and CTE analyses (a01-a09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators import timeseries as TS
from ..operators.joins import checkpointed
from ..operators.ranking import rank_all, rank_by_counts, rank_many, top_k_per_group
from ..operators.shares import distribution
from .operations import entity_metrics
from .revenue import monthly_revenue


def a01_mom_rolling_trend(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Monthly revenue, previous month, MoM %, rolling average, trend label."""
    m = monthly_revenue(adm)
    prev = TS.previous_row("_mr", "month")
    m = m.withColumn("_prev", prev)
    return m.select(
        "month", F.col("_mr").cast("double").alias("revenue"),
        F.col("_prev").cast("double").alias("prev_revenue"),
        TS.growth_pct("_mr", "_prev", 1).alias("mom_growth_pct"),
        X.rhu(TS.rolling_avg("_mr", "month", cfg.rolling_months), 2).alias("rolling_avg_3m"),
        (F.row_number().over(Window.orderBy("month")) == 1).alias("_first"),
    ).withColumn("trend_label", X.trend_label("mom_growth_pct", "_first")).drop("_first")


def a02_hospital_tiers(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """RANK, NTILE(4) and PERCENT_RANK of hospitals by revenue, with a tier."""
    g = adm.groupBy("hospital").agg(F.sum(F.col("billing_amount")).alias("_rev"))
    r = rank_all(g, [("_rev", True)], ["hospital"], rank="revenue_rank",
                 ntile=(4, "revenue_quartile"), percent_rank="_pr", cfg=cfg)
    return r.select("hospital", X.rhu("_rev", 2).alias("revenue"), "revenue_rank",
                    "revenue_quartile", X.rhu("_pr", 4).alias("pct_rank"),
                    X.quartile_tier("revenue_quartile").alias("performance_tier"))


def doctor_metrics(adm: DataFrame) -> DataFrame:
    """The scorecard's input CTE: volume, revenue, normal-outcome rate, average stay."""
    m = entity_metrics(adm, "doctor")
    return m.select("doctor", F.col("_n").alias("total_patients"), F.col("_rev"),
                    (F.col("_normal").cast("double") * 100.0 / F.col("_n"))
                    .alias("normal_outcome_rate"),
                    X.safe_div("_los", "_nlos").alias("avg_los"))


def a03_doctor_scorecard(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Four NTILE(4) dimension scores, weighted into one composite, ranked.  The
    four orders share one range shuffle.  Weights are integer percentages so ties in the score stay exact."""
    m = doctor_metrics(adm)
    wv, wr, wo, we = cfg.score_weights
    score = (F.col("volume_score") * wv + F.col("revenue_score") * wr
             + F.col("outcome_score") * wo + F.col("efficiency_score") * we)
    m = rank_many(m, [
        dict(by=[("total_patients", False)], tie=["doctor"], ntile=(4, "volume_score")),
        dict(by=[("_rev", False)], tie=["doctor"], ntile=(4, "revenue_score")),
        dict(by=[("normal_outcome_rate", False)], tie=["doctor"], ntile=(4, "outcome_score")),
        dict(by=[("avg_los", True)], tie=["doctor"], ntile=(4, "efficiency_score")),
        # four quartiles weighted: at most 4^4 scores
        dict(with_={"_score100": score}, by=[("_score100", True)], rank="overall_rank", few=True),
    ], cfg=cfg)
    return m.select(
        "doctor", "total_patients", X.rhu("_rev", 2).alias("total_revenue"),
        X.rhu("normal_outcome_rate", 2).alias("normal_outcome_rate"),
        X.rhu("avg_los", 2).alias("avg_los"),
        "volume_score", "revenue_score", "outcome_score", "efficiency_score",
        X.rhu(F.col("_score100").cast("decimal(20,0)") / 100, 2).alias("composite_score"),
        "overall_rank")


def a04_condition_insurer_cohorts(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Condition x insurer cohorts: size, revenue, average, share of the condition's revenue
    and rank within the condition (windows partitioned by condition over the aggregated
    cells)."""
    g = adm.groupBy("medical_condition", "insurance_provider").agg(
        F.count(F.lit(1)).alias("total_patients"), F.sum(F.col("billing_amount")).alias("_rev"))
    w = Window.partitionBy("medical_condition")
    return g.select(
        "medical_condition", "insurance_provider", "total_patients",
        X.rhu("_rev", 2).alias("revenue"),
        X.rhu(X.safe_div("_rev", "total_patients"), 2).alias("avg_billing"),
        X.pct("_rev", F.sum("_rev").over(w), 1).alias("share_of_condition_pct"),
        F.rank().over(w.orderBy(F.col("_rev").desc())).cast("long").alias("rank_in_condition"))


def a05_patient_risk(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Per-admission risk points, score, tier and global rank by score.  The
    score is a small bounded integer, so the global RANK comes from counts per
    score (no single-task window over the rows), which are joined to the rows
    where these are read."""
    r = X.with_risk(adm, cfg)
    r = r.select(*cfg.row_keys, "age_points", "type_points", "result_points",
                 "billing_points", "risk_score", "risk_tier")
    return rank_by_counts(r, [("risk_score", True)], rank="risk_rank", cfg=cfg)


def a06_executive_summary(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """One row of headline KPIs plus the top condition, hospital and insurer by
    revenue.  One scan: the rows are summed to condition x hospital x insurer
    cells, GROUPING SETS over the cells gives the grand total and the three
    per-entity tables; each "top" scalar is reduced from its slice with min_by
    (no revenue last, ties to the smaller name), and the one-row results are put
    side by side."""
    keys = ["medical_condition", "hospital", "insurance_provider"]
    b, los = F.col("billing_amount"), F.col("length_of_stay")
    cells = adm.groupBy(*keys).agg(
        F.sum(b).alias("_rev"), F.count(F.lit(1)).alias("_n"),
        F.count(b).alias("_nb"), F.sum(los).alias("_los"), F.count(los).alias("_nlos"),
        F.count_if(F.col("admission_type") == "Emergency").alias("_e"),
        F.count_if(F.col("test_results") == "Normal").alias("_normal"))
    sums = ("_rev", "_n", "_nb", "_los", "_nlos", "_e", "_normal")
    g = cells.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("_gid"), *[F.sum(c).alias(c) for c in sums])
    # the grouping-sets result is small (one row per condition, hospital,
    # insurer, plus the total); materialise it once so the four branches below
    # do not each re-plan (and re-scan) the fact with a pruned aggregate
    g = checkpointed(g)
    full = (1 << len(keys)) - 1          # grouping id of the grand-total set
    # this key grouped only, by its grouping id
    tops = {key: g.where(F.col("_gid") == (full & ~(1 << (len(keys) - 1 - i)))) for i, key in enumerate(keys)}
    return summary(g.where(F.col("_gid") == full), tops)


def summary(total: DataFrame, tops: dict[str, DataFrame]) -> DataFrame:
    """:func:`a06_executive_summary` from sums: ``total`` adds up to the whole,
    ``tops`` has the rows (``_rev``) of each entity by its column's name."""
    # a global aggregate: exactly one row, also for an empty input (a grouping
    # set over no rows yields none)
    tot = total.agg(*[F.sum(c).alias(c) for c in ("_rev", "_nb", "_los", "_nlos", "_e", "_normal")],
                    F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    out = tot.select(
        X.rhu("_rev", 2).alias("total_revenue"), F.col("_n").alias("total_patients"),
        X.rhu(X.safe_div("_rev", "_nb"), 2).alias("avg_billing"),
        X.rhu(X.safe_div("_los", "_nlos"), 1).alias("avg_los"),
        X.rhu(X.safe_div("_rev", "_los"), 2).alias("revenue_per_day"),
        X.pct("_e", "_n", 1).alias("emergency_pct"), X.pct("_normal", "_n", 1).alias("normal_pct"))
    names = {"medical_condition": "top_condition", "hospital": "top_hospital", "insurance_provider": "top_insurer"}
    for key, name in names.items():
        top = tops[key].agg(F.min_by(key, F.struct(
            F.col("_rev").isNull().alias("x"), (-F.col("_rev")).alias("r"),
            F.col(key).isNull().alias("y"), F.col(key).alias("k"))).alias(name))
        out = out.crossJoin(F.broadcast(top))
    return out


def a07_risk_distribution(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per risk tier with share, average billing and average stay."""
    r = X.with_risk(adm, cfg)
    return distribution(r, "risk_tier", extra={
        "avg_billing": X.rhu(X.avg_exact(F.col("billing_amount")), 2), "avg_los": X.rhu(X.avg_exact(F.col("length_of_stay")), 2)})


def a08_review_queue(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions scoring at or above the review threshold (8 in the reference)."""
    r = X.with_risk(adm, cfg).filter(F.col("risk_score") >= cfg.review_threshold)
    return r.select(*cfg.row_keys, "date_of_admission", "hospital", "doctor",
                    "risk_score", "risk_tier")


def a09_topk_insurer_per_condition(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top insurers by revenue within each condition (RANK <= k, ties kept; a
    WindowGroupLimit before the shuffle)."""
    g = adm.groupBy("medical_condition", "insurance_provider").agg(F.sum(F.col("billing_amount")).alias("_rev"))
    t = top_k_per_group(g, ["medical_condition"], [("_rev", True)], cfg.top_k_per_group,
                        "insurer_rank")
    return t.select("medical_condition", "insurance_provider",
                    X.rhu("_rev", 2).alias("revenue"), "insurer_rank")


def a10_elderly_emergency_cohort(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The oldest age group admitted as an emergency with an abnormal result:
    its size, range of risk scores and share above a billing cut."""
    r = X.with_risk(adm, cfg)
    oldest = max(cfg.risk_age_points)
    b = F.col("billing_amount")
    c = r.where((F.col("age_points") == oldest) & (F.col("admission_type") == "Emergency")
                & (F.col("test_results") == "Abnormal"))
    above = b > cfg.cohort_billing_cut
    return c.agg(
        F.count(F.lit(1)).alias("cohort_patients"), F.min("risk_score").cast("long").alias("min_risk_score"),
        F.max("risk_score").cast("long").alias("max_risk_score"),
        F.count_if(above).alias("patients_above_cut"),
        X.pct(F.count_if(above), F.count(F.lit(1)), 1).alias("pct_above_cut"),
        X.rhu(X.avg_exact(b), 2).alias("avg_billing"))
