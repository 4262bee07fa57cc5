"""Dashboard datasets not covered by an analysis, and the measure catalogue
under a filter context (d01-d04, m01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..functions.measures import evaluate, slice_, slice_condition
from .operations import entity_metrics


CARD_MEASURES = ("total_revenue", "total_patients", "avg_billing", "avg_length_of_stay")


def d01_monthly_admissions(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per month (page-1 line chart)."""
    return adm.groupBy(X.month_start().alias("month")).agg(
        F.count(F.lit(1)).alias("total_patients"))


def d02_condition_scatter(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Average stay against average billing per condition (page-2 scatter)."""
    return condition_scatter(entity_metrics(adm, "medical_condition"))


def condition_scatter(g: DataFrame) -> DataFrame:
    """:func:`d02_condition_scatter` from the conditions' sums."""
    return g.select("medical_condition", F.col("_n").alias("total_patients"),
                    X.rhu(X.safe_div("_los", "_nlos"), 2).alias("avg_los"),
                    X.rhu(X.safe_div("_rev", "_nb"), 2).alias("avg_billing"))


def d03_sliced_cards(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Page-1 cards under a slicer selection (one year and one admission type)."""
    return evaluate(adm, CARD_MEASURES, where=dict(cfg.slice_example))


def d04_variance_vs_network(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Average billing per hospital under the slicers minus the network average
    that ignores them (a measure evaluated outside the filter context).  One
    scan: per hospital, the sliced sums are conditional aggregates next to the
    unsliced ones, and the network figure is the total of the latter."""
    from ..operators.shares import with_totals
    ctx = slice_condition(**dict(cfg.slice_example))
    b = F.col("billing_amount")
    h = adm.groupBy("hospital").agg(
        F.sum(F.when(ctx, b)).alias("_ss"), F.count(F.when(ctx, b)).alias("_sc"),
        F.sum(b).alias("_s"), F.count(b).alias("_c"))
    h = with_totals(h, _ns=F.sum("_s"), _nc=F.sum("_c"))
    sliced = X.rhu(X.safe_div("_ss", "_sc"), 2)
    net = X.rhu(X.safe_div("_ns", "_nc"), 2)
    return h.where(F.col("_sc") > 0).select(
        "hospital", sliced.alias("sliced_avg_billing"), net.alias("network_avg_billing"),
        X.rhu(sliced - net, 2).alias("variance_vs_network"))


def m01_measures_by_year(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Every catalogue measure on the year axis."""
    from ..functions.measures import MEASURES
    return evaluate(adm, list(MEASURES), by=[F.year("date_of_admission").cast("long").alias("year")])


def _ranked_sliced(adm: DataFrame, key: str, cfg: Config) -> DataFrame:
    from ..operators.ranking import rank_all
    g = slice_(adm, **dict(cfg.slice_example)).groupBy(key).agg(
        F.sum(F.col("billing_amount")).alias("_rev"))
    r = rank_all(g, [("_rev", True)], [key], rank="revenue_rank",
                 dense_rank="revenue_dense_rank", ntile=(4, "revenue_quartile"), cfg=cfg)
    return r.select(key, X.rhu("_rev", 2).alias("revenue"), "revenue_rank",
                    "revenue_dense_rank", "revenue_quartile")


def d05_hospital_rank_sliced(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """RANKX / NTILE measures under the slicers: hospitals ranked (RANKX
    ``skip`` = RANK and ``dense`` = DENSE_RANK) and split into quartiles by
    revenue within the filter context only."""
    return _ranked_sliced(adm, "hospital", cfg)


def d06_doctor_rank_sliced(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The same measures for doctors."""
    return _ranked_sliced(adm, "doctor", cfg)


def d07_sliced_conditions(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The condition visual of a page under its slicers, answered from the
    slicers' pre-aggregate as the published page does."""
    from ..sources.marts import sliced_page, slices
    return sliced_page(slices(adm), ("medical_condition",), **dict(cfg.slice_example))


def d08_sliced_stays(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Quartiles of the length of stay and distinct hospitals per condition under
    a page's slicers, from the pages' mergeable cells (counts per stay; slices)."""
    from ..sources.marts import sliced_distinct_hospitals, sliced_median_stay, slices, stays
    ctx, by = dict(cfg.slice_example), ("medical_condition",)
    q = sliced_median_stay(stays(adm), by, **ctx)
    h = sliced_distinct_hospitals(slices(adm), by, **ctx).withColumnRenamed("medical_condition", "_c")
    return h.join(q, F.col("_c").eqNullSafe(F.col("medical_condition")), "left").select(
        F.col("_c").alias("medical_condition"), "p25_los", "median_los", "p75_los", "distinct_hospitals")
