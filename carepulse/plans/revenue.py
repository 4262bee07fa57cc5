"""Revenue analyses (r01-r13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators import timeseries as TS
from ..operators.quantiles import percentiles
from ..operators.ranking import rank_all
from ..operators.shares import grand


def r01_billing_kpis(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Total, average, median and quartiles of billing (exact percentiles): one
    scan gives total, average and a sketch, a second the exact ranks (a third
    only where doubles cannot tell the values apart)."""
    q = percentiles(adm, "billing_amount",
                    {"median_billing": 0.5, "p25_billing": 0.25, "p75_billing": 0.75}, cfg,
                    summary=True)
    return q.select(X.rhu("_sum", 2).alias("total_revenue"),
                    X.rhu(X.safe_div("_sum", "_n"), 2).alias("avg_billing"),
                    *[X.rhu(c, 2).alias(c) for c in ("median_billing", "p25_billing",
                                                     "p75_billing")])


def _revenue_by(adm: DataFrame, *key: str) -> DataFrame:
    """Revenue and admissions per value of ``key``."""
    return adm.groupBy(*key).agg(F.sum(F.col("billing_amount")).alias("_rev"), F.count(F.lit(1)).alias("_n"))


def r02_condition_share(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Revenue per condition, its share of all revenue and its rank."""
    return condition_share(_revenue_by(adm, "medical_condition"))


def condition_share(g: DataFrame) -> DataFrame:
    """:func:`r02_condition_share` from the conditions' revenue ``_rev``."""
    g = g.withColumn("_all", grand("_rev"))
    g = g.withColumn("revenue_rank", F.rank().over(Window.orderBy(F.col("_rev").desc()))
                     .cast("long"))
    return g.select("medical_condition", X.rhu("_rev", 2).alias("revenue"),
                    X.pct("_rev", "_all", 1).alias("share_pct"), "revenue_rank")


def r03_insurer_ranking(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Revenue, average billing and admissions per insurer, ranked by revenue."""
    g = _revenue_by(adm, "insurance_provider")
    g = g.withColumn("revenue_rank", F.rank().over(Window.orderBy(F.col("_rev").desc()))
                     .cast("long"))
    return g.select("insurance_provider", X.rhu("_rev", 2).alias("revenue"),
                    X.rhu(X.safe_div("_rev", "_n"), 2).alias("avg_billing"),
                    F.col("_n").alias("total_patients"), "revenue_rank")


def top_n_by(g: DataFrame, key: str, metric: str, n: int, rank_name: str) -> DataFrame:
    """Top ``n`` entities by ``metric`` (ties broken by key).  The limit is a
    distributed TakeOrderedAndProject; the rank is computed on those n rows,
    which equals the global rank since every better row is among them."""
    top = g.orderBy(F.col(metric).desc_nulls_last(), F.col(key).asc()).limit(n)
    return top.withColumn(rank_name, F.rank().over(
        Window.orderBy(F.col(metric).desc_nulls_last())).cast("long"))


def r04_hospital_top10(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top hospitals by revenue (distributed top-n)."""
    t = top_n_by(_revenue_by(adm, "hospital"), "hospital", "_rev", cfg.top_n, "revenue_rank")
    return t.select("hospital", X.rhu("_rev", 2).alias("revenue"), "revenue_rank")


def monthly_revenue(adm: DataFrame) -> DataFrame:
    """Months (their first day) with their revenue as an exact DECIMAL."""
    return adm.groupBy(X.month_start().alias("month")).agg(
        F.round(F.sum(F.col("billing_amount")), 2).alias("_mr"))


def r05_monthly_trend(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Monthly revenue, running total and month-over-month growth."""
    return monthly_trend(monthly_revenue(adm))


def monthly_trend(m: DataFrame) -> DataFrame:
    """:func:`r05_monthly_trend` from the months' revenue ``_mr``."""
    prev = TS.previous_row("_mr", "month")
    return m.select(
        "month",
        F.col("_mr").cast("double").alias("monthly_revenue"),
        TS.running_total("_mr", "month").cast("double").alias("running_total"),
        TS.growth_pct(F.col("_mr"), prev, 1).alias("mom_growth_pct"),
    ).orderBy("month")


def r06_billing_tiers(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions and revenue per billing tier with both shares."""
    g = adm.groupBy(X.billing_tier("billing_amount", cfg).alias("billing_tier")).agg(
        F.count(F.lit(1)).alias("total_patients"), F.sum(F.col("billing_amount")).alias("_rev"))
    g = g.withColumns({"_n": grand("total_patients"), "_r": grand("_rev")})
    return g.select("billing_tier", "total_patients", X.rhu("_rev", 2).alias("revenue"),
                    X.pct("total_patients", "_n", 1).alias("pct_patients"),
                    X.pct("_rev", "_r", 1).alias("pct_revenue"))


def r07_high_value_cohort(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions above the top billing cut: count, revenue and their shares (one conditional
    aggregate)."""
    cut = cfg.billing_cuts[-1]
    hv = F.col("billing_amount") > cut
    one = adm.agg(F.count_if(hv).alias("cohort_patients"), F.count(F.lit(1)).alias("_n"),
                  F.sum(F.when(hv, F.col("billing_amount"))).alias("_cr"), F.sum(F.col("billing_amount")).alias("_r"))
    return one.select(F.lit(float(cut)).alias("billing_cut"), "cohort_patients",
                      X.pct("cohort_patients", "_n", 1).alias("pct_patients"),
                      X.rhu(F.coalesce("_cr", F.lit(0)), 2).alias("cohort_revenue"),
                      X.pct(F.coalesce("_cr", F.lit(0)), "_r", 1).alias("pct_revenue"))


def hospital_quartiles(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Hospitals with revenue and NTILE(4) by revenue, highest first."""
    g = _revenue_by(adm, "hospital")
    return rank_all(g, [("_rev", True)], ["hospital"], ntile=(4, "revenue_quartile"), cfg=cfg)


def r08_hospital_quartiles(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Hospitals and revenue per revenue quartile (NTILE(4), highest first)."""
    q = hospital_quartiles(adm, cfg).groupBy("revenue_quartile").agg(
        F.count(F.lit(1)).alias("hospitals"), F.sum("_rev").alias("_rev"))
    q = q.withColumn("_all", grand("_rev"))
    return q.select("revenue_quartile", "hospitals", X.rhu("_rev", 2).alias("revenue"),
                    X.pct("_rev", "_all", 1).alias("share_pct"))


def r09_quartile_ratio(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Top-quartile hospital revenue over bottom-quartile revenue."""
    q = hospital_quartiles(adm, cfg).agg(
        F.sum(F.when(F.col("revenue_quartile") == 1, F.col("_rev"))).alias("_top"),
        F.sum(F.when(F.col("revenue_quartile") == 4, F.col("_rev"))).alias("_bot"))
    return q.select(X.rhu("_top", 2).alias("top_quartile_revenue"),
                    X.rhu("_bot", 2).alias("bottom_quartile_revenue"),
                    X.rhu(X.safe_div("_top", "_bot"), 2).alias("top_to_bottom_ratio"))


def r10_condition_admission_matrix(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Condition x admission type revenue (stacked bar / matrix) with each
    cell's share of all revenue and its conditional-formatting bucket (ratio
    to the mean cell)."""
    return condition_admission_matrix(_revenue_by(adm, "medical_condition", "admission_type"), cfg)


def condition_admission_matrix(g: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """:func:`r10_condition_admission_matrix` from the cells' ``_n`` and ``_rev``."""
    g = g.withColumns({"_tot": grand("_rev"), "_cells": F.count(F.lit(1)).over(Window.partitionBy())})
    ratio = F.try_divide(F.col("_rev").cast("double") * F.col("_cells"), F.col("_tot").cast("double"))
    return g.select("medical_condition", "admission_type", F.col("_n").alias("total_patients"),
                    X.rhu("_rev", 2).alias("revenue"), X.pct("_rev", "_tot", 1).alias("share_pct"),
                    X.rhu(ratio, 3).alias("heat_ratio"), X.cell_bucket(ratio, cfg).alias("cell_bucket"))


OTHER = "other"


def r11_insurer_condition_matrix(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Insurer rows x one revenue column per listed condition, ``other`` for
    the revenue of every other condition and of none, the insurer's total, and
    each listed cell's conditional-formatting bucket (ratio to the mean
    non-empty cell).  Each column is a conditional sum in one aggregate, so no
    job looks for the columns and a row always adds up to its total."""
    return insurer_condition_matrix(adm, "billing_amount", cfg)


def insurer_condition_matrix(rows: DataFrame, amount: str, cfg: Config = DEFAULTS) -> DataFrame:
    """:func:`r11_insurer_condition_matrix` from admissions, or from sums of them
    by insurer and condition."""
    vals = list(cfg.condition_values)
    c, b = F.col("medical_condition"), F.col(amount)
    listed = F.coalesce(c.isin(*vals), F.lit(False))
    p = rows.groupBy("insurance_provider").agg(
        *[F.sum(F.when(c == v, b)).alias(v) for v in vals],
        F.sum(F.when(~listed, b)).alias(OTHER), F.sum(b).alias("_total"))
    cells = [F.col(f"`{v}`") for v in (*vals, OTHER)]
    n = sum((x.isNotNull().cast("long") for x in cells[1:]), cells[0].isNotNull().cast("long"))
    p = p.withColumn("_n", n).withColumns({"_all": grand("_total"), "_cells": grand("_n")})

    def ratio(v):
        return F.try_divide(F.col(f"`{v}`").cast("double") * F.col("_cells"), F.col("_all").cast("double"))
    return p.select(
        "insurance_provider", *[X.rhu(F.col(f"`{v}`"), 2).alias(v) for v in (*vals, OTHER)],
        X.rhu("_total", 2).alias("insurer_total"),
        *[F.when(F.col(f"`{v}`").isNotNull(), X.cell_bucket(ratio(v), cfg)).alias(f"{v}_bucket")
          for v in vals])


def r12_monthly_calendar_mom(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Dense calendar months: revenue (0 for an empty month), revenue of the
    previous calendar month (blank if that month was empty), MoM % and YTD."""
    m = adm.groupBy(X.month_start().alias("month")).agg(F.sum(F.col("billing_amount")).alias("_rev"))
    d = TS.calendar_previous(m, "_rev", "month", "_last")
    d = d.withColumn("_r0", F.coalesce("_rev", F.lit(0).cast("decimal(28,2)")))
    return d.select(
        "month",
        X.rhu("_r0", 2).alias("revenue"),
        X.rhu("_last", 2).alias("revenue_last_month"),
        TS.growth_pct(F.col("_r0"), F.col("_last"), 1).alias("mom_growth_pct"),
        X.rhu(TS.year_to_date("_r0", "month"), 2).alias("revenue_ytd"),
    )


def r13_matrix_totals(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Insurer x condition revenue with row, column and grand totals: the rows
    are summed to cells first, the CUBE expands the cells only."""
    cells = adm.groupBy("insurance_provider", "medical_condition").agg(
        F.sum(F.col("billing_amount")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return cells.cube("insurance_provider", "medical_condition").agg(
        X.rhu(F.sum("_s"), 2).alias("revenue"), F.sum("_n").alias("total_patients"),
        F.grouping("insurance_provider").cast("long").alias("is_insurer_total"),
        F.grouping("medical_condition").cast("long").alias("is_condition_total"))
