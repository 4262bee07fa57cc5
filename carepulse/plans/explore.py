"""Exploratory analyses: data-quality audits and distributions (e01-e10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..operators.joins import join_counted
from ..operators.shares import distribution
from ..sources.schema import COLUMNS


def e01_row_audit(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Row count, date span and distinct entity counts, in one scan.  The rows
    are summed per combination of the entities first (map-side combined), and
    the exact distinct counts expand those; ``cfg.approx_distinct`` switches to
    HyperLogLog++ sketches."""
    dc = F.approx_count_distinct if cfg.approx_distinct else F.countDistinct
    cells = adm.groupBy("hospital", "doctor", "medical_condition", "insurance_provider").agg(
        F.count(F.lit(1)).alias("_n"), F.min("date_of_admission").alias("_lo"),
        F.max("date_of_admission").alias("_hi"))
    return cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"),
        F.min("_lo").alias("min_date"),
        F.max("_hi").alias("max_date"),
        dc("hospital").alias("distinct_hospitals"),
        dc("doctor").alias("distinct_doctors"),
        dc("medical_condition").alias("distinct_conditions"),
        dc("insurance_provider").alias("distinct_insurers"),
    )


def e02_null_audit(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """NULL count and share per column: one aggregate pass, then an unpivot of
    that single row (instead of one scan per column joined by UNION ALL)."""
    one = adm.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in COLUMNS])
    long = one.unpivot(["_n"], list(COLUMNS), "column_name", "null_count")
    return long.select("column_name", F.col("null_count").cast("long").alias("null_count"),
                       X.pct("null_count", "_n", 2).alias("null_pct"))


def e03_duplicate_audit(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Key values that occur more than once, with their number of copies.
    Partial aggregation collapses a hot key before the shuffle."""
    keys = list(cfg.duplicate_keys)
    return (adm.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
               .filter(F.col("copies") > 1))


def e11_full_duplicate_audit(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Rows equal in all columns of the source file, with their copies.  A
    128-bit fingerprint is counted for every row first; the fingerprints that
    occur twice are measured and, below the byte bound, broadcast, so only the
    rows that have one leave the task that reads them."""
    def mark(c):      # the length tells values apart, a dash is a NULL
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    rows = adm.select(*COLUMNS, F.unhex(F.md5(F.concat_ws("|", *[mark(c) for c in COLUMNS]))).alias("_fp"))
    twice = rows.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_fp")
    return (join_counted(rows, twice, ["_fp"], "left_semi").groupBy(*COLUMNS)
            .agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
            .withColumn("billing_amount", F.col("billing_amount").cast("double")))


def range_rules(cfg: Config = DEFAULTS) -> dict:
    los = X.length_of_stay()
    return {
        "discharge_before_admission": F.col("discharge_date") < F.col("date_of_admission"),
        "zero_length_stay": los == 0,
        "non_positive_billing": F.col("billing_amount") <= 0,
        "age_out_of_range": (F.col("age") < 0) | (F.col("age") > cfg.max_valid_age),
        "missing_admission_date": F.col("date_of_admission").isNull(),
    }


def e04_range_audit(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Violations per validity rule, one conditional-aggregate pass."""
    rules = range_rules(cfg)
    one = adm.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    long = one.unpivot([], list(rules), "rule", "violations")
    return long.select("rule", F.col("violations").cast("long").alias("violations"))


def e05_age_groups(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The reference's age segmentation with a percentage of the total."""
    return distribution(adm, X.age_group("age"), "age_group").orderBy("age_group")


def e06_gender_dist(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per gender with share."""
    return distribution(adm, "gender")


def e07_blood_type_dist(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per blood type with share."""
    return distribution(adm, "blood_type")


def e08_condition_counts(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per condition with share."""
    return distribution(adm, "medical_condition")


def e09_medication_overview(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per medication with share."""
    return distribution(adm, "medication")


def e10_admission_type_dist(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Admissions per admission type with share (the donut chart)."""
    return distribution(adm, "admission_type")
