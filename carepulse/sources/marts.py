"""Dashboard marts (S5) and their refresh (S6).

The fact is summed once to *cells*, stored by year; everything a page shows is
derived from them, each visual from its smallest ancestor::

    admissions -> slices   sums by all slicers and month, hospital, test result
                  -> months, matrix cells, hospitals, outcome cells
               -> doctors  sums by year, admission type and doctor
               -> stays    rows per length of stay, by the pages' slicers
               -> billing  rows per logarithmic billing bucket, by the same
               -> people   HyperLogLog sketches of doctors, by the same

The twelve visuals take two scans of the fact (slices, doctors).  Counts per
stay give exact medians under any slicers, buckets billing percentiles within
1 % of the value, sketches distinct doctors (standard error 1.6 %), hospitals
are counted exactly.

**Refresh.**  A refresh limited to years reads those years of the fact only,
replaces their cells, and rewrites what depends on them: a month's own numbers
in the same year, running totals and growth in every later year too, marts
without a month as a whole.  The result equals a full rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators.joins import checkpointed
from ..operators.quantiles import bucket_value, log_bucket, quantiles_of_counts
from ..operators.ranking import rank_all
from ..operators.shares import shared
from ..plans import advanced, dashboard, operations, registry, revenue

# dashboard page -> visual datasets (analysis keys)
PAGES = {
    "executive_overview": ("a06_executive_summary", "e10_admission_type_dist",
                           "r02_condition_share", "d01_monthly_admissions"),
    "revenue_deep_dive": ("r10_condition_admission_matrix", "r11_insurer_condition_matrix",
                          "r05_monthly_trend", "d02_condition_scatter"),
    "operational_intelligence": ("o04_revenue_per_day_hospital", "o07_emergency_rate",
                                 "o08_test_outcome_stack", "o09_doctor_bar"),
}

SLICER_COLUMNS = ("year", "month", "hospital", "medical_condition", "insurance_provider",
                  "admission_type", "test_results", "gender")
DOCTOR_COLUMNS = ("year", "admission_type", "doctor")
#: What the pages slice by (gender, condition, year; insurer, type; hospital).
STATE_COLUMNS = ("year", "hospital", "medical_condition", "insurance_provider", "admission_type", "gender")
#: log2 of the registers of a distinct-count sketch: standard error 1.04 / sqrt(2^12).
SKETCH_BITS = 12


def _by(adm: DataFrame, columns: tuple[str, ...]):
    keys = {"year": F.year("date_of_admission"), "month": X.month_start()}
    return adm.groupBy(*[keys.get(c, F.col(c)).alias(c) for c in columns])


def _sums() -> list[Column]:
    b, los = F.col("billing_amount"), F.col("length_of_stay")
    return [F.count(F.lit(1)).alias("patients"), F.sum(b).alias("revenue_sum"), F.count(b).alias("billed"),
            F.sum(los).alias("days"), F.count(los).alias("stays")]


def slices(adm: DataFrame) -> DataFrame:
    """The shared pre-aggregate: additive sums per slicer combination."""
    return _by(adm, SLICER_COLUMNS).agg(*_sums())


def doctors(adm: DataFrame) -> DataFrame:
    """Additive sums per doctor, year and admission type."""
    normal = F.count_if(F.col("test_results") == "Normal").alias("normal")
    return _by(adm, DOCTOR_COLUMNS).agg(*_sums(), normal)


def stays(adm: DataFrame) -> DataFrame:
    """Rows per length of stay: an exact histogram per slicer combination."""
    keyed = adm.withColumn("year", F.year("date_of_admission"))
    return keyed.groupBy(*STATE_COLUMNS, "length_of_stay").agg(F.count(F.lit(1)).alias("n"))


def billing(adm: DataFrame) -> DataFrame:
    """Rows per billing bucket: a mergeable quantile sketch per slicer combination."""
    keyed = adm.withColumns({"year": F.year("date_of_admission"), "bucket": log_bucket(F.col("billing_amount"))})
    return keyed.groupBy(*STATE_COLUMNS, "bucket").agg(F.count(F.lit(1)).alias("n"))


def people(adm: DataFrame) -> DataFrame:
    """A distinct-count sketch of the doctors per slicer combination."""
    return _by(adm, STATE_COLUMNS).agg(F.hll_sketch_agg("doctor", F.lit(SKETCH_BITS)).alias("doctors"))


CELLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "slices": slices, "doctors": doctors, "stays": stays, "billing": billing, "people": people}


# ------------------------------------------------------------------ visuals
def rolled(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells summed up to ``keys``, under the names of the analyses' own sums."""
    has = set(cells.columns)
    n = F.col("patients")
    sums = {"_n": n, "_rev": F.col("revenue_sum"), "_nb": F.col("billed"), "_los": F.col("days"),
            "_nlos": F.col("stays")}
    if "admission_type" in has:
        sums["_e"] = F.when(F.col("admission_type") == "Emergency", n).otherwise(0)
    if "test_results" in has:
        sums["_normal"] = F.when(F.col("test_results") == "Normal", n).otherwise(0)
    elif "normal" in has:
        sums["_normal"] = F.col("normal")
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def _monthly(s: DataFrame) -> DataFrame:
    return rolled(s, "month").select("month", F.round("_rev", 2).alias("_mr"), F.col("_n").alias("total_patients"))


# key -> (the stored cells it is derived from, the derivation)
VISUALS: dict[str, tuple[str, Callable[[DataFrame, Config], DataFrame]]] = {
    "a06_executive_summary": ("slices", lambda s, cfg: advanced.summary(
        rolled(s), {k: rolled(s, k) for k in ("medical_condition", "hospital", "insurance_provider")})),
    "e10_admission_type_dist": ("slices", lambda s, cfg: shared(
        rolled(s, "admission_type").select("admission_type", F.col("_n").alias("total_patients")))),
    "r02_condition_share": ("slices", lambda s, cfg: revenue.condition_share(rolled(s, "medical_condition"))),
    "d01_monthly_admissions": ("slices", lambda s, cfg: _monthly(s).select("month", "total_patients")),
    "r10_condition_admission_matrix": ("slices", lambda s, cfg: revenue.condition_admission_matrix(
        rolled(s, "medical_condition", "admission_type"), cfg)),
    "r11_insurer_condition_matrix": ("slices", lambda s, cfg: revenue.insurer_condition_matrix(
        rolled(s, "insurance_provider", "medical_condition"), "_rev", cfg)),
    "r05_monthly_trend": ("slices", lambda s, cfg: revenue.monthly_trend(_monthly(s).select("month", "_mr"))),
    "d02_condition_scatter": ("slices", lambda s, cfg: dashboard.condition_scatter(rolled(s, "medical_condition"))),
    "o04_revenue_per_day_hospital": ("slices", lambda s, cfg: operations.revenue_per_day_top(
        rolled(s, "hospital"), cfg)),
    "o07_emergency_rate": ("slices", lambda s, cfg: operations.emergency_rates(
        rolled(s, "hospital").select("hospital", "_n", "_e"), cfg)),
    "o08_test_outcome_stack": ("slices", lambda s, cfg: operations.outcome_stack(
        rolled(s, "hospital", "medical_condition", "test_results"))),
    "o09_doctor_bar": ("doctors", lambda d, cfg: operations.top_doctors(rolled(d, "doctor"), cfg)),
}
#: Marts by month in which a year's rows depend on all years before.
CUMULATIVE = ("r05_monthly_trend",)


# ------------------------------------------------------------------ storage
def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _folder(spark, path)
    return fs.exists(where)


def _years(rows: DataFrame, span: tuple[int, int]) -> set[int]:
    """The different years in the span (a calendar's worth)."""
    return {r[0] for r in rows.where(F.col("year").between(*span)).select("year").distinct().collect()}


def _replace(rows: DataFrame, path: str, span: tuple[int, int] | None) -> None:
    """Write ``rows`` by their column ``year`` as the stored table's: all of it,
    or its years in ``span`` (first, last), of which those without rows go."""
    spark = rows.sparkSession
    # few files of Spark's advisory size a year; a large year is split
    rows = rows.hint("rebalance", F.col("year"))
    if span is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("year").parquet(path)
        return
    rows = checkpointed(rows.where(F.col("year").between(*span)))    # small; read twice
    gone = _years(spark.read.parquet(path), span) - _years(rows, span)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    for y in gone:
        where, fs = _folder(spark, f"{path}/year={y}")
        fs.delete(where, True)


def write_cells(adm: DataFrame, out_dir: str, years: tuple[int, int] | None = None,
                names: tuple[str, ...] = tuple(CELLS)) -> list[str]:
    """Write the cells under ``out_dir/<name>``, by year: one scan of the fact
    each, of the given years (first, last) only if there are any and the cells
    were written before."""
    out, changed = [], adm
    if years:
        within = F.year("date_of_admission").between(*years)
        if "admission_year" in adm.columns:          # prunes the stored table's folders
            within = within & F.col("admission_year").between(*years)
        changed = adm.where(within)
    for name in names:
        path = f"{out_dir.rstrip('/')}/{name}"
        if years and _exists(adm.sparkSession, path):
            _replace(CELLS[name](changed), path, years)
        else:
            _replace(CELLS[name](adm), path, None)
        out.append(path)
    return out


def read_cells(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/{name}")


def write_slices(adm: DataFrame, out_dir: str) -> str:
    """Write :func:`slices` (one scan of the fact), partitioned by year."""
    return write_cells(adm, out_dir, names=("slices",))[0]


def write_marts(adm: DataFrame, out_dir: str, cfg: Config = DEFAULTS,
                pages: dict | None = None, years: tuple[int, int] | None = None) -> list[str]:
    """Write the cells, then every visual's dataset from them under
    ``out_dir/<page>/<key>`` (a key that no cells hold, from the fact).  With
    ``years`` (first, last) only these years of the fact are read, and the marts
    end up as a full run would leave them."""
    pages = pages or PAGES
    keys = [k for ks in pages.values() for k in ks]
    need = tuple(sorted({VISUALS[k][0] for k in keys if k in VISUALS}, reverse=True))
    write_cells(adm, out_dir, years, need)
    return _write_visuals(adm, out_dir, cfg, pages, years)


def _write_visuals(adm: DataFrame, out_dir: str, cfg: Config, pages: dict,
                   years: tuple[int, int] | None) -> list[str]:
    spark, written = adm.sparkSession, []
    for page, keys in pages.items():
        for key in keys:
            path = f"{out_dir.rstrip('/')}/{page}/{key}"
            if key in VISUALS:
                source, derive = VISUALS[key]
                ds = derive(read_cells(spark, out_dir, source), cfg)
            else:
                ds = registry.ANALYSES[key](adm, cfg)
            if "month" in ds.columns:
                # a stored mart's years that cannot have changed stay as they are
                keep = years and key in VISUALS and _exists(spark, path)
                span = (years[0], 9999 if key in CUMULATIVE else years[1]) if keep else None
                _replace(ds.withColumn("year", F.year("month")), path, span)
            else:
                ds.write.mode("overwrite").parquet(path)
            written.append(path)
    return written


def refresh_marts(adm: DataFrame, out_dir: str, cfg: Config = DEFAULTS,
                  years: tuple[int, int] | None = None) -> list[str]:
    """S6: bring all cells and marts up to date, for all years or the given ones."""
    cells = write_cells(adm, out_dir, years)
    return [*_write_visuals(adm, out_dir, cfg, PAGES, years), *cells]


# ------------------------------------------------------------------ slicers
def sliced(cells: DataFrame, **ctx) -> DataFrame:
    """Cells under slicer selections: a value, or a list of values, by column;
    ``year_range`` (first, last)."""
    for c, v in ctx.items():
        if c == "year_range":
            cells = cells.where(F.col("year").between(*v))
        elif c not in cells.columns:
            raise ValueError(f"no slicer {c!r}")
        else:
            cells = cells.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return cells


def sliced_page(pre: DataFrame, by: tuple[str, ...] = (), **ctx) -> DataFrame:
    """Additive measures by any of :data:`SLICER_COLUMNS` under slicer selections,
    from the pre-aggregate."""
    out = sliced(pre, **ctx).groupBy(*by).agg(
        F.coalesce(F.sum("patients"), F.lit(0)).alias("total_patients"),
        F.sum("revenue_sum").alias("_r"), F.sum("billed").alias("_b"),
        F.sum("days").alias("_d"), F.sum("stays").alias("_s"))
    return out.select(*by, "total_patients", X.rhu("_r", 2).alias("total_revenue"),
                      X.rhu(X.safe_div("_r", "_b"), 2).alias("avg_billing"),
                      X.rhu(X.safe_div("_d", "_s"), 1).alias("avg_length_of_stay"),
                      X.rhu(X.safe_div("_r", "_d"), 2).alias("revenue_per_day"))


def sliced_ranks(pre: DataFrame, key: str, cfg: Config = DEFAULTS, **ctx) -> DataFrame:
    """RANKX and NTILE of hospitals (from slices) or doctors (from doctors) by
    revenue under slicer selections, without the fact."""
    g = sliced(pre, **ctx).groupBy(key).agg(F.sum("revenue_sum").alias("_rev"))
    r = rank_all(g, [("_rev", True)], [key], rank="revenue_rank", dense_rank="revenue_dense_rank",
                 ntile=(4, "revenue_quartile"), cfg=cfg)
    return r.select(key, X.rhu("_rev", 2).alias("revenue"), "revenue_rank", "revenue_dense_rank",
                    "revenue_quartile")


def sliced_median_stay(stay_cells: DataFrame, by: tuple[str, ...] = (), **ctx) -> DataFrame:
    """Median and quartiles of the length of stay, exact, from the histogram."""
    counts = sliced(stay_cells, **ctx).groupBy(*by, "length_of_stay").agg(F.sum("n").alias("n"))
    q = quantiles_of_counts(counts, by, "length_of_stay", "n", {"p25_los": 0.25, "median_los": 0.5, "p75_los": 0.75})
    return q.select(*by, *[X.rhu(c, 2).alias(c) for c in ("p25_los", "median_los", "p75_los")])


def sliced_billing_percentiles(billing_cells: DataFrame, by: tuple[str, ...] = (), **ctx) -> DataFrame:
    """Quartiles of billing from the bucket counts: each within 1 % of the exact
    value (of the nearest ranks' values, where it lies between two)."""
    counts = sliced(billing_cells, **ctx).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("_value", bucket_value(F.col("bucket")))
    q = quantiles_of_counts(counts, by, "_value", "n", {"p25_billing": 0.25, "median_billing": 0.5, "p75_billing": 0.75})
    return q.select(*by, *[X.rhu(c, 2).alias(c) for c in ("p25_billing", "median_billing", "p75_billing")])


def sliced_distinct_doctors(people_cells: DataFrame, by: tuple[str, ...] = (), **ctx) -> DataFrame:
    """Distinct doctors from the merged sketches (standard error 1.6 %)."""
    return sliced(people_cells, **ctx).groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("doctors")).alias("distinct_doctors"))


def sliced_distinct_hospitals(pre: DataFrame, by: tuple[str, ...] = (), **ctx) -> DataFrame:
    """Distinct hospitals, exact."""
    seen = sliced(pre, **ctx).select(*by, "hospital").distinct()
    return seen.groupBy(*by).agg(F.count("hospital").alias("distinct_hospitals"))
