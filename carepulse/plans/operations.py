"""Operational efficiency: doctors, hospitals, rooms, revenue per day (o01-o12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators.joins import join_counted
from ..operators.ranking import ntile_of, placed
from ..operators.shares import distribution, with_totals
from .revenue import top_n_by


def entity_metrics(adm: DataFrame, key: str) -> DataFrame:
    """Per-entity sums and counts; averages and rates are derived from them,
    and the network row is the sum of these sums (one fact scan)."""
    b, los = F.col("billing_amount"), F.col("length_of_stay")
    return adm.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(b).alias("_rev"), F.sum(los).alias("_los"),
        F.count(los).alias("_nlos"), F.count(b).alias("_nb"),
        F.count_if(F.col("test_results") == "Normal").alias("_normal"))


def o01_doctor_benchmark(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Per-doctor volume, revenue, average billing and stay, normal-result rate, and the
    average billing's difference from the network average (from the doctors' own sums; the
    doctor rows are materialised once so the fact is scanned once)."""
    m = with_totals(entity_metrics(adm, "doctor"), _net_rev=F.sum("_rev"), _net_nb=F.sum("_nb"))
    avg_b = X.rhu(X.safe_div("_rev", "_nb"), 2)
    net_b = X.rhu(X.safe_div("_net_rev", "_net_nb"), 2)
    return m.select(
        "doctor", F.col("_n").alias("total_patients"), X.rhu("_rev", 2).alias("revenue"),
        avg_b.alias("avg_billing"), X.rhu(X.safe_div("_los", "_nlos"), 2).alias("avg_los"),
        X.pct("_normal", "_n", 1).alias("normal_rate"),
        X.rhu(avg_b - net_b, 2).alias("billing_diff_vs_network"))


def o02_hospital_vs_network(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Hospital average billing against the network average (the reference's
    CROSS JOIN with a one-row CTE).  The network average is the row-weighted
    average, derived from the hospital sums, so the fact is scanned once."""
    h = adm.groupBy("hospital").agg(F.sum(F.col("billing_amount")).alias("_s"), F.count(F.col("billing_amount")).alias("_c"))
    net = h.agg(X.rhu(X.safe_div(F.sum("_s"), F.sum("_c")), 2).alias("network_avg_billing"))
    h = h.select("hospital", X.rhu(X.safe_div("_s", "_c"), 2).alias("avg_billing"))
    j = h.crossJoin(F.broadcast(net))
    return j.select(
        "hospital", "avg_billing", "network_avg_billing",
        X.rhu(F.col("avg_billing") - F.col("network_avg_billing"), 2)
        .alias("diff_from_network_avg"),
        X.above_below("avg_billing", "network_avg_billing").alias("flag"),
    ).orderBy(F.col("diff_from_network_avg").desc())


def o03_room_utilization(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Occupied days per room against the mean room, with a utilisation tier."""
    r = adm.groupBy("room_number").agg(F.count(F.lit(1)).alias("admissions"),
                                       F.sum(F.col("length_of_stay")).alias("_days"))
    r = with_totals(r, _all=F.sum("_days"), _rooms=F.count(F.lit(1)))
    ratio = X.rhu(X.safe_div(F.col("_days") * F.col("_rooms"), F.col("_all")), 2)
    return r.select("room_number", "admissions", F.col("_days").cast("long").alias("occupied_days"),
                    ratio.alias("utilization_ratio")) \
            .withColumn("utilization_tier", X.room_tier("utilization_ratio", cfg))


def o04_revenue_per_day_hospital(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top hospitals by revenue per day (ratio of sums, DIVIDE semantics) beside
    the network's figure."""
    return revenue_per_day_top(entity_metrics(adm, "hospital"), cfg)


def revenue_per_day_top(m: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """:func:`o04_revenue_per_day_hospital` from the hospitals' sums."""
    m = with_totals(m, _nrev=F.sum("_rev"), _nlos_all=F.sum("_los"))
    m = m.withColumn("_rpd", X.safe_div("_rev", "_los"))
    t = top_n_by(m, "hospital", "_rpd", cfg.top_n, "rpd_rank")
    return t.select("hospital", X.rhu("_rev", 2).alias("revenue"),
                    F.col("_los").cast("long").alias("total_los_days"),
                    X.rhu("_rpd", 2).alias("revenue_per_day"), "rpd_rank",
                    X.rhu(X.safe_div("_nrev", "_nlos_all"), 2).alias("network_revenue_per_day"))


def o05_revenue_per_day_admission_type(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Per admission type: share, average billing, average stay and revenue per day (ratio of
    sums)."""
    d = distribution(adm, "admission_type", extra={
        "avg_billing": X.rhu(X.avg_exact(F.col("billing_amount")), 2), "avg_los": X.rhu(X.avg_exact(F.col("length_of_stay")), 2),
        "revenue_per_day": X.rhu(X.safe_div(F.sum(F.col("billing_amount")), F.sum(F.col("length_of_stay"))), 2)})
    return d


def o06_long_stay_patients(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions staying longer than ``long_stay_factor`` times their
    condition's average (an equi-join of the rows to a per-condition aggregate,
    then a row filter).  The averages are computed and measured first, so the
    rows are filtered where they are read."""
    avg = adm.groupBy("medical_condition").agg(X.avg_exact(F.col("length_of_stay")).alias("_avg")) \
        .where(F.col("medical_condition").isNotNull())
    j = join_counted(adm, avg, ["medical_condition"])
    j = j.filter(F.col("length_of_stay") > F.col("_avg") * cfg.long_stay_factor)
    return j.select(*cfg.row_keys, "medical_condition", "hospital",
                    F.col("billing_amount").cast("double").alias("billing_amount"),
                    F.col("length_of_stay").cast("long").alias("length_of_stay"),
                    X.rhu("_avg", 2).alias("condition_avg_los"),
                    X.rhu(X.safe_div("length_of_stay", "_avg"), 2).alias("los_ratio"))


def o07_emergency_rate(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Emergency share for the network and for each hospital against the target
    (rows summed per hospital first; the ROLLUP expands the hospitals only)."""
    h = adm.groupBy("hospital").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("admission_type") == "Emergency").alias("_e"))
    return emergency_rates(h, cfg)


def emergency_rates(h: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """:func:`o07_emergency_rate` from the hospitals' ``_n`` and ``_e``."""
    g = h.rollup("hospital").agg(F.grouping("hospital").alias("_g"),
                                 F.sum("_n").alias("total_patients"), F.sum("_e").alias("_e"))
    pct = X.pct("_e", "total_patients", 1)
    return g.select(
        F.when(F.col("_g") == 1, "network").otherwise("hospital").alias("scope_type"),
        F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col("hospital")).alias("scope"),
        "total_patients", pct.alias("emergency_pct"),
        F.lit(float(cfg.emergency_target_pct)).alias("target_pct"),
        X.rhu(pct - F.lit(float(cfg.emergency_target_pct)), 1).alias("gap_pct"))


def o08_test_outcome_stack(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Result mix within each hospital and each condition (100% stacked bars),
    both groupings over the hospital x condition x result cells."""
    return outcome_stack(adm.groupBy("hospital", "medical_condition", "test_results").agg(
        F.count(F.lit(1)).alias("_n")))


def outcome_stack(cells: DataFrame) -> DataFrame:
    """:func:`o08_test_outcome_stack` from the cells' ``_n``."""
    g = cells.groupingSets(
        [["hospital", "test_results"], ["medical_condition", "test_results"]],
        "hospital", "medical_condition", "test_results",
    ).agg(F.sum("_n").alias("total_patients"), F.grouping("hospital").alias("_gh"))
    g = g.select(
        F.when(F.col("_gh") == 0, "hospital").otherwise("condition").alias("dimension"),
        F.when(F.col("_gh") == 0, F.col("hospital")).otherwise(F.col("medical_condition"))
        .alias("member"), "test_results", "total_patients")
    w = Window.partitionBy("dimension", "member")
    return g.withColumn("pct_within", X.pct("total_patients", F.sum("total_patients").over(w), 1))


def o09_doctor_bar(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top doctors by revenue (distributed top-n)."""
    return top_doctors(entity_metrics(adm, "doctor"), cfg)


def top_doctors(m: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """:func:`o09_doctor_bar` from the doctors' sums."""
    t = top_n_by(m, "doctor", "_rev", cfg.top_n, "revenue_rank")
    return t.select("doctor", X.rhu("_rev", 2).alias("revenue"),
                    F.col("_n").alias("total_patients"), "revenue_rank")


def o10_top_bottom_performers(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top- and bottom-quartile hospitals and doctors by revenue: both kinds of
    entity from one scan (grouping sets over hospital x doctor cells) and ranked
    by one range shuffle."""
    cells = adm.groupBy("hospital", "doctor").agg(F.sum("billing_amount").alias("_rev"))
    g = cells.groupingSets([["hospital"], ["doctor"]], "hospital", "doctor").agg(
        F.grouping("hospital").alias("_g"), F.sum("_rev").alias("_rev"))
    by_doctor = F.col("_g") == 1
    g = g.select(F.when(by_doctor, "doctor").otherwise("hospital").alias("entity_type"),
                 F.when(by_doctor, F.col("doctor")).otherwise(F.col("hospital")).alias("entity"), "_rev")
    q = placed(g, "entity_type", [F.col("_rev").desc_nulls_last(), F.col("entity").asc_nulls_first()])
    q = q.withColumn("revenue_quartile", ntile_of(F.col("_rn"), F.col("_all"), 4))
    return q.filter(F.col("revenue_quartile").isin(1, 4)).select(
        "entity_type", "entity", X.rhu("_rev", 2).alias("revenue"), "revenue_quartile",
        F.when(F.col("revenue_quartile") == 1, "Top").otherwise("Bottom").alias("performer"))


def o11_gap_to_network(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Hospital revenue as a percentage of the average hospital's revenue and
    whether it is within ``gap_band_pct`` of it."""
    h = adm.groupBy("hospital").agg(F.sum(F.col("billing_amount")).alias("_rev"))
    h = with_totals(h, _all=F.sum("_rev"), _k=F.count(F.lit(1)))
    net = X.safe_div("_all", "_k")
    p = X.safe_div(F.col("_rev").cast("double") * F.lit(100.0) * F.col("_k"), F.col("_all"))
    return h.select("hospital", X.rhu("_rev", 2).alias("revenue"),
                    X.rhu(net, 2).alias("network_avg_revenue"),
                    X.rhu(p, 1).alias("pct_of_network_avg"),
                    (F.abs(p - 100.0) <= cfg.gap_band_pct).alias("within_band"))


def o12_day_mix_shift(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Blended averages when ``mix_shift_pct`` points of volume move from
    Emergency to Elective admissions, with per-type averages held fixed."""
    t = F.col("admission_type")
    one = adm.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("billing_amount")).alias("rev"), F.sum(F.col("length_of_stay")).alias("los"),
        F.count_if(t == "Emergency").alias("ne"), F.sum(F.when(t == "Emergency", F.col("billing_amount"))).alias("be"),
        F.sum(F.when(t == "Emergency", F.col("length_of_stay"))).alias("le"),
        F.count_if(t == "Elective").alias("nl"), F.sum(F.when(t == "Elective", F.col("billing_amount"))).alias("bl"),
        F.sum(F.when(t == "Elective", F.col("length_of_stay"))).alias("ll"))
    s = cfg.mix_shift_pct / 100.0
    d = lambda a, b: X.safe_div(a, b)
    base_b, base_l = d("rev", "n"), d("los", "n")
    sh_b = base_b + F.lit(s) * (d("bl", "nl") - d("be", "ne"))
    sh_l = base_l + F.lit(s) * (d("ll", "nl") - d("le", "ne"))
    return one.select(
        X.rhu(base_b, 2).alias("base_avg_billing"), X.rhu(base_l, 2).alias("base_avg_los"),
        X.rhu(d("rev", "los"), 2).alias("base_revenue_per_day"),
        X.rhu(sh_b, 2).alias("shifted_avg_billing"), X.rhu(sh_l, 2).alias("shifted_avg_los"),
        X.rhu(F.try_divide(sh_b, sh_l), 2).alias("shifted_revenue_per_day"))


def o13_hospital_risk_profile(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Two sets of hospital metrics, operations and patient risk, joined on the
    hospital (NULL-safe: admissions without a hospital are one entity)."""
    ops = entity_metrics(adm, "hospital")
    risk = X.with_risk(adm, cfg).groupBy(F.col("hospital").alias("_h")).agg(
        F.sum("risk_score").alias("_score"),
        F.count_if(F.col("risk_score") >= cfg.review_threshold).alias("review_patients"))
    j = ops.join(risk, F.col("hospital").eqNullSafe(F.col("_h")))
    return j.select("hospital", F.col("_n").alias("total_patients"), X.rhu("_rev", 2).alias("revenue"),
                    X.rhu(X.safe_div("_score", "_n"), 2).alias("avg_risk_score"), "review_patients",
                    X.pct("review_patients", "_n", 1).alias("review_pct"))
