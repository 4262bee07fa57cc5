"""Time-series operators over monthly aggregates.

Monthly series are bounded by the calendar (about a dozen rows a year), so
their ordered windows run in one task on purpose; the per-row data is reduced
by a partial + final hash aggregate before any of this happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def running_total(value: str, order: str) -> Column:
    """Sum of the values up to and with the current row."""
    return F.sum(value).over(Window.orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))


def year_to_date(value: str, month: str) -> Column:
    """Running sum restarting each calendar year."""
    return F.sum(value).over(Window.partitionBy(F.year(month)).orderBy(month).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))


def previous_row(value: str, order: str) -> Column:
    """The value of the row before, of the rows that are present."""
    return F.lag(value).over(Window.orderBy(order))


def rolling_avg(value: str, order: str, k: int) -> Column:
    """Average of the current and ``k - 1`` preceding rows, exact over
    DECIMAL/INT input (sum and count over the frame, one division)."""
    w = Window.orderBy(order).rowsBetween(-(k - 1), Window.currentRow)
    return X.safe_div(F.sum(value).over(w), F.count(value).over(w))


def growth_pct(cur: str | Column, prev: str | Column, digits: int = 1) -> Column:
    """Change in percent of the previous value; NULL if that is 0 or missing."""
    c, p = X.col(cur), X.col(prev)
    return X.rhu(F.try_divide((c - p).cast("double") * F.lit(100.0), F.nullif(p, F.lit(0)).cast("double")), digits)


def calendar_previous(monthly: DataFrame, value: str, month: str = "month",
                      out: str = "last_month") -> DataFrame:
    """Every calendar month from the first to the last present month (J5),
    with ``value`` (NULL for an empty month) and the value of the previous
    *calendar* month (blank when that month had no rows), as DAX time
    intelligence reads it.

    The monthly series (bounded by the calendar, not by the data) is folded
    into one row holding a month -> value map; the dense spine is exploded from
    that row and both lookups are map reads, so the aggregate is consumed by a
    single branch (no self-join that would re-plan the fact scan)."""
    # rows without a date have no calendar month; the spine spans real months
    one = monthly.where(F.col(month).isNotNull()).agg(
        F.min(month).alias("_lo"), F.max(month).alias("_hi"),
        F.map_from_entries(F.collect_list(F.struct(month, value))).alias("_m"))
    d = one.select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month),
                   "_m")
    return d.select(month, F.try_element_at("_m", F.col(month)).alias(value),
                    F.try_element_at("_m", F.add_months(month, -1)).alias(out))
