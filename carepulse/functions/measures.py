"""Measure catalogue (the reference's DAX measures) and slicers.

A measure is a named aggregate ``Column``.  ``evaluate`` applies a filter
context (slicers) and groups by any axes, which is what a DAX measure does
under a visual's filter context.  Measures that must ignore the context
(comparisons with the network) read the unsliced DataFrame instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exprs as X


def _share(cond: Column) -> Column:
    return X.pct(F.count_if(cond), F.count(F.lit(1)), 1)


# name -> zero-argument builder of an aggregate Column
MEASURES: dict[str, Callable[[], Column]] = {
    "total_revenue": lambda: X.rhu(F.sum(F.col("billing_amount")), 2),
    "total_patients": lambda: F.count(F.lit(1)),
    "avg_billing": lambda: X.rhu(X.avg_exact(F.col("billing_amount")), 2),
    "avg_length_of_stay": lambda: X.rhu(X.avg_exact(F.col("length_of_stay")), 1),
    "revenue_per_day": lambda: X.rhu(X.safe_div(F.sum(F.col("billing_amount")), F.sum(F.col("length_of_stay"))), 2),
    "emergency_rate_pct": lambda: _share(F.col("admission_type") == "Emergency"),
    "elective_rate_pct": lambda: _share(F.col("admission_type") == "Elective"),
    "urgent_rate_pct": lambda: _share(F.col("admission_type") == "Urgent"),
    "normal_rate_pct": lambda: _share(F.col("test_results") == "Normal"),
    "abnormal_rate_pct": lambda: _share(F.col("test_results") == "Abnormal"),
    "inconclusive_rate_pct": lambda: _share(F.col("test_results") == "Inconclusive"),
    "emergency_admissions": lambda: F.count_if(F.col("admission_type") == "Emergency"),
    "elective_admissions": lambda: F.count_if(F.col("admission_type") == "Elective"),
    "urgent_admissions": lambda: F.count_if(F.col("admission_type") == "Urgent"),
    "urgent_revenue": lambda: X.rhu(
        F.sum(F.when(F.col("admission_type") == "Urgent", F.col("billing_amount"))), 2),
    "emergency_revenue": lambda: X.rhu(
        F.sum(F.when(F.col("admission_type") == "Emergency", F.col("billing_amount"))), 2),
    "elective_revenue": lambda: X.rhu(
        F.sum(F.when(F.col("admission_type") == "Elective", F.col("billing_amount"))), 2),
    "total_los_days": lambda: F.sum(F.col("length_of_stay")).cast("long"),
}

# Measures that need a time axis or ranking (revenue last month, MoM growth,
# YTD, RANKX, NTILE, variance vs network) are in operators.timeseries and the
# analyses; they cannot be a single aggregate Column.


def measure(name: str) -> Column:
    return MEASURES[name]().alias(name)


# Slicers: keyword -> column; a scalar means equality, a list/tuple/set means
# membership, a 2-element ``range(lo, hi)``-like dict means inclusive bounds.
SLICERS = {
    "gender": "gender",
    "medical_condition": "medical_condition",
    "condition": "medical_condition",
    "insurance_provider": "insurance_provider",
    "insurer": "insurance_provider",
    "admission_type": "admission_type",
    "hospital": "hospital",
    "doctor": "doctor",
    "year": None,
}


def slice_(adm: DataFrame, **ctx) -> DataFrame:
    """Apply slicer selections as one ANDed filter (pushed down to the scan;
    a year range prunes admission_year partitions of the stored table)."""
    cond = slice_condition("admission_year" in adm.columns, **ctx)
    return adm if cond is None else adm.filter(cond)


def slice_condition(partitioned: bool = False, **ctx) -> Column | None:
    """The slicer selections as one boolean Column (None when empty)."""
    cond = None
    for key, val in ctx.items():
        if val is None:
            continue
        if key in ("year", "year_range"):
            c = F.year("date_of_admission")
            if isinstance(val, (tuple, list)) and key == "year_range":
                lo, hi = val
                p = F.col("date_of_admission").between(
                    F.make_date(F.lit(lo), F.lit(1), F.lit(1)),
                    F.make_date(F.lit(hi), F.lit(12), F.lit(31)))
                if partitioned:
                    p = p & F.col("admission_year").between(lo, hi)
            elif isinstance(val, (tuple, list, set)):
                p = c.isin(*val)
                if partitioned:
                    p = p & F.col("admission_year").isin(*val)
            else:
                # a date range (not YEAR(d) = v) so Parquet min/max stats apply,
                # plus the partition column of the stored table when present
                p = F.col("date_of_admission").between(
                    F.make_date(F.lit(val), F.lit(1), F.lit(1)),
                    F.make_date(F.lit(val), F.lit(12), F.lit(31)))
                if partitioned:
                    p = p & (F.col("admission_year") == val)
        else:
            c = F.col(SLICERS.get(key, key))
            if isinstance(val, (tuple, list, set)):
                p = c.isin(*val)
            else:
                p = c == val
        cond = p if cond is None else cond & p
    return cond


def evaluate(adm: DataFrame, measures, by=(), where: dict | None = None) -> DataFrame:
    """Evaluate measures under a filter context, grouped by ``by`` axes."""
    df = slice_(adm, **(where or {}))
    aggs = [measure(m) for m in measures]
    if by:
        return df.groupBy(*by).agg(*aggs)
    return df.agg(*aggs)
