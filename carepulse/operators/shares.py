"""Shares of a total and group distributions.

A share of all rows needs the total beside each group: a window without a
partition moves the *grouped* rows into one task.  For a categorical axis (condition, insurer,
admission type, a tier label) the grouped rows are a handful, so that is the
cheapest plan (:func:`grand`).  For entity-level rows (hospitals, doctors,
rooms) the total is instead a global aggregate - provably one row - broadcast
next to the grouped rows (:func:`with_totals`), so no task sees all entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .joins import checkpointed


def grand(c) -> Column:
    """Whole-result total of an aggregated categorical column."""
    return F.sum(c).over(Window.partitionBy())


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Attach whole-table aggregates (one row, broadcast) to every row.

    ``df`` (grouped entity rows) is checkpointed first: a second branch over
    the same aggregate is otherwise planned again - Catalyst prunes each
    branch's aggregate to the columns it needs, the two exchanges differ and
    the fact is scanned twice."""
    df = checkpointed(df)
    one = df.agg(*[c.alias(k) for k, c in totals.items()])
    return df.crossJoin(F.broadcast(one))


def distribution(adm: DataFrame, key: Column | str, name: str | None = None,
                 count_name: str = "total_patients", pct_name: str = "pct_of_total",
                 digits: int = 1, extra: dict | None = None) -> DataFrame:
    """Rows per value of a categorical ``key`` with their percentage of all rows."""
    k = X.col(key)
    if name:
        k = k.alias(name)
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return shared(adm.groupBy(k).agg(*aggs), count_name, pct_name, digits)


def shared(g: DataFrame, count_name: str = "total_patients", pct_name: str = "pct_of_total",
           digits: int = 1) -> DataFrame:
    """Rows of a categorical axis with their percentage of all."""
    return g.withColumn(pct_name, X.pct(count_name, grand(count_name), digits))
