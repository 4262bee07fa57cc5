"""Exact percentiles (``PERCENTILE_CONT``) that scale.

Spark's exact ``percentile`` aggregate keeps a value -> count map and merges it
in one final task; with high-cardinality money values that map is the whole
column.  Here two passes select the ranks exactly:

1. A mergeable quantile sketch (``percentile_approx``) gives two values around
   each wanted rank, beside the count, sum, minimum and maximum.
2. Rows between two such values (a few ten-thousandths of all) are counted per
   value, all other rows per gap between them; both are map-side combined.  In
   their order (range-partitioned, running sums per partition) the rank's value
   is the one whose running count passes it.

If a rank lies in a gap all the same (doubles that cannot tell two decimals
apart), a third pass takes that gap as its bracket, which cannot miss.

The passes run when the function is called: the second one's filter is the
first one's result, and the range sort of the bracket needs a checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from .joins import checkpointed
from .ranking import rows_before

#: The sketch's ranks are right to the row count over this.
ACCURACY = 10_000


def bracketed(v: DataFrame, brackets: list[tuple]) -> DataFrame:
    """The rows of ``v`` counted per value inside the closed ``brackets`` (``x``)
    and per gap outside (``x`` NULL): ``c``, least ``lo`` and greatest ``hi``."""
    c = F.col("v")
    inside, passed = F.lit(False), F.lit(0)
    for lo, hi in brackets:
        inside = inside | c.between(F.lit(lo), F.lit(hi))
        passed = passed + (c > F.lit(hi)).cast("int")
    return v.groupBy(F.when(inside, c).alias("x"), F.when(~inside, passed).alias("gap")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).drop("gap")


def select_ranks(v: DataFrame, ranks: list[int], brackets: list[tuple]) -> DataFrame:
    """One row with ``at<rank>``, the values at the 0-based ``ranks`` of ``v``
    (not NULL); the brackets say where they are expected."""
    def holds(r: int):
        return (F.col("_before") <= r) & (F.col("_before") + F.col("c") > r)
    while True:
        rows = checkpointed(rows_before(bracketed(v, brackets), [F.col("lo").asc()], "c"))
        wanted = F.lit(False)
        for r in ranks:
            wanted = wanted | holds(r)
        gaps = rows.where(wanted & F.col("x").isNull()).select("lo", "hi").collect()   # a few ranks
        if not gaps:
            return rows.agg(*[F.max(F.when(holds(r), F.col("x"))).alias(f"at{r}") for r in ranks])
        brackets = [*brackets, *((g["lo"], g["hi"]) for g in gaps)]


def exact_percentiles(df: DataFrame, column: str, probs: dict[str, float],
                      cfg: Config = DEFAULTS, summary: bool = False) -> DataFrame:
    """One row with a DOUBLE column per ``name -> p``, linear interpolation
    between closest ranks (R-7 / PERCENTILE_CONT).  NULLs are ignored; an empty
    input gives NULLs.  With ``summary`` the row also carries ``_n`` (non-NULL
    count), ``_sum`` (exact sum in the column's type), ``_min`` and ``_max``."""
    v = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    around = sorted({min(1.0, max(0.0, p + d / ACCURACY)) for p in probs.values() for d in (-2, 2)})
    one = v.agg(F.sum("v").alias("_sum"), F.min("v").alias("_min"), F.max("v").alias("_max"),
                F.count("v").alias("_n"), F.percentile_approx("v", around, ACCURACY).alias("_at"))
    row = one.first()
    n, types = row["_n"], dict(one.dtypes)
    extra = [F.lit(row[c]).cast(types[c]).alias(c) for c in ("_sum", "_min", "_max", "_n")] if summary else []
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(k) for k in probs], *extra)
    value = dict(zip(around, row["_at"])) | {0.0: row["_min"], 1.0: row["_max"]}
    brackets = sorted({(value[min(1.0, max(0.0, p - 2 / ACCURACY))], value[min(1.0, max(0.0, p + 2 / ACCURACY))])
                       for p in probs.values()})
    places = {k: p * (n - 1) for k, p in probs.items()}
    ranks = sorted({f(x) for x in places.values() for f in (math.floor, math.ceil)})
    at = select_ranks(v, ranks, brackets)

    def between(x: float):
        a, b = F.col(f"at{math.floor(x)}").cast("double"), F.col(f"at{math.ceil(x)}").cast("double")
        return a + (b - a) * F.lit(x - math.floor(x))
    return at.select(*[between(x).alias(k) for k, x in places.items()], *extra)


def percentiles(df: DataFrame, column: str, probs: dict[str, float],
                cfg: Config = DEFAULTS, summary: bool = False) -> DataFrame:
    """Exact by default; ``cfg.percentile_accuracy > 0`` switches to Spark's
    ``percentile_approx`` (a mergeable sketch, one pass, bounded memory)."""
    if cfg.percentile_accuracy > 0:
        c = F.col(column)
        arr = F.percentile_approx(c.cast("double"), list(probs.values()),
                                  cfg.percentile_accuracy)
        extra = [F.sum(c).alias("_sum"), F.min(c).alias("_min"), F.max(c).alias("_max"),
                 F.count(c).alias("_n")] if summary else []
        one = df.agg(arr.alias("_q"), *extra)
        return one.select(*[F.col("_q")[i].alias(k) for i, k in enumerate(probs)],
                          *([F.col(x) for x in ("_sum", "_min", "_max", "_n")] if summary else []))
    return exact_percentiles(df, column, probs, cfg, summary)


def quantiles_of_counts(counts: DataFrame, by: tuple[str, ...], value: str, n: str,
                        probs: dict[str, float]) -> DataFrame:
    """Per group ``by`` the percentiles (as :func:`exact_percentiles`) of values
    given with their row counts ``n``, one row per group and value.  A window
    holds a group's different values only."""
    w = Window.partitionBy(*by)
    rows = counts.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v"),
        F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.sum(n).over(w).alias("_all"))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    out = {}
    for name, p in probs.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        low = F.floor(place)
        out[name] = at(low), at(F.ceil(place)), F.max(place - low)
    g = rows.groupBy(*by).agg(*[c.alias(f"_{k}{i}") for k, cs in out.items() for i, c in enumerate(cs)])
    return g.select(*by, *[(F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * F.col(f"_{k}2")).alias(k)
                           for k in out])


#: Relative error of a value that :func:`log_bucket` stands for.
BUCKET_ERROR = 0.01
_GAMMA = (1 + BUCKET_ERROR) / (1 - BUCKET_ERROR)


def log_bucket(v: Column) -> Column:
    """A whole number, rising with ``v``, of a logarithmic scale: values that
    share it differ by a factor of (1 + e) / (1 - e) at most.  Counts per bucket
    add up, so they are a mergeable quantile sketch.  Covers |v| from 1e-9 (what
    is smaller counts as 0)."""
    size = F.ceil(F.log(F.abs(v.cast("double")) * 1e9) / F.lit(math.log(_GAMMA)))
    return F.when(v.isNull(), F.lit(None)).when(F.abs(v.cast("double")) <= 1e-9, F.lit(0)).otherwise(
        F.signum(v.cast("double")) * size).cast("int")


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket: within :data:`BUCKET_ERROR` of all in it."""
    size = F.pow(F.lit(_GAMMA), F.abs(b)) * F.lit(2 / (_GAMMA + 1) * 1e-9)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * size)
