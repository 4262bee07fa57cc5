"""The admissions table: schema, CSV import, standardisation, Parquet storage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators.joins import checkpointed, join_counted
from ..session import SHUFFLES_GO, ensure_checkpoint_dir, settings

# The fifteen columns of the source file, in file order, with our Spark types.
SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("blood_type", T.StringType()),
    T.StructField("medical_condition", T.StringType()),
    T.StructField("date_of_admission", T.DateType()),
    T.StructField("doctor", T.StringType()),
    T.StructField("hospital", T.StringType()),
    T.StructField("insurance_provider", T.StringType()),
    T.StructField("billing_amount", T.DecimalType(18, 2)),
    T.StructField("room_number", T.IntegerType()),
    T.StructField("admission_type", T.StringType()),
    T.StructField("discharge_date", T.DateType()),
    T.StructField("medication", T.StringType()),
    T.StructField("test_results", T.StringType()),
])
COLUMNS = tuple(f.name for f in SCHEMA.fields)


# where Spark's reader notes a line with another number of fields
BROKEN = "_corrupt"
# text columns that are keys of an analysis
FOLDED = ("gender", "blood_type", "medical_condition", "doctor", "hospital", "insurance_provider",
          "admission_type", "medication", "test_results")


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files' columns as text, bound by the header's names: any order is
    read right, a missing, unknown or repeated column is an error.  Files of one
    folder must share one header line; one with another is an error when read."""
    names = spark.read.option("header", True).csv(path).columns
    cols = [snake(c) for c in names]
    wrong = sorted(set(COLUMNS) - set(cols)), sorted(set(cols) - set(COLUMNS) - {"admission_id"})
    if wrong[0] or wrong[1] or len(set(cols)) < len(cols):
        raise ValueError(f"CSV header: missing {wrong[0]}, unknown or repeated {wrong[1]} in {names}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*names, BROKEN)])
    raw = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", BROKEN).option("enforceSchema", False)
           .option("columnPruning", False).csv(path))      # else short lines go unnoticed
    return raw.withColumnsRenamed(dict(zip(names, cols)))


def read_admissions(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd",
                    fold_case: bool = False) -> DataFrame:
    """S1: CSV import with explicit types (no inference pass over the data).
    Values that cannot be read are NULL here and listed by :func:`read_rejects`."""
    return standardise(read_raw(spark, path), date_format=date_format, fold_case=fold_case)


def _typed(f: T.StructField, date_format: str):
    c = F.col(f.name).cast("string")
    if isinstance(f.dataType, T.DateType):
        return F.coalesce(F.try_to_date(c, date_format), c.try_cast("date"))
    if isinstance(f.dataType, T.StringType):
        return F.nullif(F.trim(c), F.lit(""))
    return F.trim(c).try_cast(f.dataType)


REJECT = "struct<column_name:string,raw_text:string,reason:string>"


def _rejected(date_format: str) -> Column:
    """Array of the values of a raw line that cannot be read."""
    bad = [F.when(F.col(BROKEN).isNotNull(), F.struct(
        F.lit("line").alias("column_name"), F.col(BROKEN).alias("raw_text"),
        F.lit("number of fields").alias("reason")))]
    for f in SCHEMA.fields:
        if not isinstance(f.dataType, T.StringType):
            c = F.col(f.name)
            wrong = (F.trim(c) != "") & _typed(f, date_format).isNull() & F.col(BROKEN).isNull()
            bad.append(F.when(wrong, F.struct(
                F.lit(f.name).alias("column_name"), c.alias("raw_text"),
                F.lit(f"not a {f.dataType.simpleString()}").alias("reason"))))
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def read_rejects(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """One row per value of the CSV files that was not read: ``column_name``
    (``line`` for a line with another number of fields), ``raw_text`` (the value,
    or the line), ``reason``.  Kept apart from the fact."""
    raw = read_raw(spark, path)
    return raw.select(F.explode(_rejected(date_format)).alias("r")).select("r.*")


class ImportMismatch(RuntimeError):
    """What an import wrote does not add up to the lines it read."""


def import_admissions(spark: SparkSession, csv: str, table: str, rejects: str,
                      date_format: str = "yyyy-MM-dd", fold_case: bool = False) -> dict[str, int]:
    """S1-S3 in one parse of the CSV files: the typed rows and, beside each, the
    values that could not be read go to a staging table; from it the admissions
    table and the table of rejects are written.  Lines, lines with a reject and
    rejected values are counted while they pass (``observe``) in each of the
    three writes; if the counts differ, :class:`ImportMismatch` says so.  The rows
    of a large table appear pass by pass (:func:`write_admissions`).  Returns
    ``lines``, ``rows``, ``bad_lines``, ``rejected`` (values written)."""
    stage = f"{ensure_checkpoint_dir(spark).rstrip('/')}/import-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(stage)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    read, refused = Observation("read"), Observation("refused")
    raw = read_raw(spark, csv)
    keep = [c for c in raw.columns if c not in COLUMNS and c != BROKEN]
    rows = raw.select(*keep, *[_typed(f, date_format).alias(f.name) for f in SCHEMA.fields],
                      _rejected(date_format).cast(f"array<{REJECT}>").alias("_rejects"))
    rows.observe(read, F.count(F.lit(1)).alias("lines"), F.sum(F.size("_rejects")).alias("values"),
                 F.count_if(F.size("_rejects") > 0).alias("bad")).write.option("compression", CODEC).parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    # the id, 64 digits that do not compress, is made where the row is written
    typed = staged.drop("_rejects")
    if fold_case:
        typed = one_spelling(typed, FOLDED)
    written = write_admissions(typed, table, count=True, finish=with_admission_id)
    bad = staged.where(F.size("_rejects") > 0).select(F.explode("_rejects").alias("r")).select("r.*")
    bad.observe(refused, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(rejects)
    out = {"lines": read.get["lines"], "rows": written, "bad_lines": read.get["bad"],
           "rejected": refused.get["n"]}
    if out["lines"] != out["rows"] or (read.get["values"] or 0) != out["rejected"]:
        raise ImportMismatch(f"read {out['lines']} lines and {read.get['values']} bad values, wrote {out}")
    fs.delete(where, True)
    return out


def standardise(df: DataFrame, date_format: str = "yyyy-MM-dd",
                fold_case: bool = False) -> DataFrame:
    """S2: snake_case names, typed columns, trimmed text.  With ``fold_case``
    the spellings of a text that differ in case only (SQL Server compares
    case-insensitively by default) become one: the most frequent, then the
    smallest, of those that occur; hospital and doctor included."""
    return with_admission_id(_standardised(df, date_format, fold_case))


def _standardised(df: DataFrame, date_format: str, fold_case: bool) -> DataFrame:
    df = df.withColumnsRenamed({c: snake(c) for c in df.columns if c != BROKEN and snake(c) != c})
    keep = [c for c in df.columns if c not in COLUMNS and c != BROKEN]
    res = df.select(*keep, *[_typed(f, date_format).alias(f.name) for f in SCHEMA.fields])
    if fold_case:
        res = one_spelling(res, FOLDED)
    return res


#: Different spellings of a column up to which its replacements are an expression.
FEW_SPELLINGS = 64


def one_spelling(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Replace each value of ``columns`` by the spelling that stands for its case.

    One pass counts the spellings of all columns together; what is left are the
    spellings that lose, checkpointed.  A column with few of them is replaced by
    an expression, so in all but the names there is no join; the others are
    joined to their measured dictionary."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("s")) for c in columns])).alias("p")
    counts = df.select(pairs).select("p.*").where("s is not null").groupBy("c", "s").agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c", F.lower("s").alias("low")).agg(
        F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("shown"), F.collect_list("s").alias("all"))
    lost = checkpointed(best.where(F.size("all") > 1).select("c", "shown", F.explode("all").alias("s"))
                        .where("s <> shown"))
    size = {r["c"]: r["count"] for r in lost.groupBy("c").count().collect()}     # a row per column
    few = [c for c in columns if 0 < size.get(c, 0) <= FEW_SPELLINGS]
    words: dict[str, list] = {c: [] for c in few}
    for r in lost.where(F.col("c").isin(*few)).collect() if few else []:
        words[r["c"]] += [F.lit(r["s"]), F.lit(r["shown"])]
    out = df.withColumns({c: F.coalesce(F.try_element_at(F.create_map(*w), F.col(c)), F.col(c))
                          for c, w in words.items()}) if few else df
    for c in columns:
        if size.get(c, 0) > FEW_SPELLINGS:
            side = lost.where(F.col("c") == c).select(F.col("s").alias(c), F.col("shown").alias("_shown"))
            out = join_counted(out, side, [c], "left").withColumn(c, F.coalesce("_shown", c)).drop("_shown")
    return out.select(*df.columns)


def with_admission_id(df: DataFrame) -> DataFrame:
    """A content key for row-level outputs when the source carries none: the
    SHA-256 of the values with their lengths and explicit NULL marks, so no two
    different rows share it; exact duplicate rows do, as they are the same
    admission twice (:func:`e11_full_duplicate_audit` counts them)."""
    if "admission_id" in df.columns:
        return df

    def mark(c):
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return df.withColumn("admission_id", F.sha2(F.concat_ws("|", *[mark(c) for c in COLUMNS]), 256))


def with_derived(adm: DataFrame) -> DataFrame:
    """Derived columns every analysis may use; unused ones are pruned by Catalyst."""
    cols = {"length_of_stay": X.length_of_stay(), "admission_month": X.month_start()}
    if "admission_year" not in adm.columns:   # keep a stored table's partition column
        cols["admission_year"] = F.year("date_of_admission")
    return adm.withColumns(cols)


#: Rows that a task sorts in memory.
SORTED_ROWS = 1_000_000
#: Files that a task which sorts nothing writes at a time.
OPEN_YEARS = 32
#: Rows that are shuffled at a time, so that the disks hold the shuffle files of
#: these only, and the most passes that a table is divided into for it.
PASS_ROWS, MOST_PASSES = 16_000_000, 4
#: Parquet codec of stored tables: the 64 hex digits of an id take half the bytes.
CODEC = "zstd"


def passes(rows: int) -> int:
    """Passes in which so many rows are shuffled."""
    return max(1, min(MOST_PASSES, -(-rows // PASS_ROWS)))


def runs(df: DataFrame, keys: list[Column], n: int, rows: int) -> list[Column]:
    """Conditions of which each of the ``rows`` rows meets exactly one: at most
    ``n`` runs in the order of ``keys``, about equally long, cut at sampled rows."""
    names = [f"k{i}" for i in range(len(keys))]
    place = F.struct(*[k.alias(c) for k, c in zip(keys, names)])
    some = df.select(place.alias("k")).sample(min(1.0, 500 * n / max(1, rows)), seed=1).orderBy("k")
    types = {f.name: f.dataType for f in some.schema["k"].dataType.fields}
    found = [r["k"] for r in some.collect()]         # 500 a run
    at = dict.fromkeys(found[len(found) * i // n] for i in range(1, n)) if found else {}
    # in a struct's order nulls come first, as in the sort
    cuts = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in names]) for r in at]
    if not cuts:
        return [F.lit(True)]
    return [place < cuts[0], *[(place >= a) & (place < b) for a, b in zip(cuts, cuts[1:])], place >= cuts[-1]]


def write_admissions(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None,
                     cluster_by: tuple[str, ...] = ("hospital", "date_of_admission"),
                     count: bool = False,
                     finish: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """S3: Parquet partitioned by admission year, so a year slicer prunes
    folders.  Rows are range-partitioned by year and ``cluster_by``: a file
    holds a range of hospitals, so file and row-group statistics skip data, and
    there are at most ``files`` + years files (default: the shuffle partitions,
    more where a task would sort over ``SORTED_ROWS`` rows), not tasks x years.
    A hospital with a third of all rows is split by date.  Without ``cluster_by``
    rows stay in their tasks and order; up to ``OPEN_YEARS`` years are written side
    by side, as sorting a task's rows by year would spill.  Spark samples the range
    bounds by reading ``df`` once more, so pass a stored table, not a join.
    ``finish`` adds columns that follow from a row to the sorted rows, so that they
    are neither moved nor sorted.  With ``count`` the rows written are counted as
    they pass, and returned.

    Over ``PASS_ROWS`` rows the table is written in passes, runs of it in the order
    of year and ``cluster_by`` (:func:`runs`), and the shuffle files of a pass go
    with it; there is a file more a pass at most.  If a later pass fails,
    an overwritten table is removed, an appended one keeps the passes before.  A
    dynamic overwrite takes one pass."""
    spark = df.sparkSession
    use = SHUFFLES_GO if cluster_by else {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_YEARS)}
    with settings(spark, use):
        return _write_passes(df, path, mode, files, [F.col(c) for c in cluster_by], count, finish)


def _write_passes(df: DataFrame, path: str, mode: str, files: int | None, keys: list[Column], count: bool,
                  finish: Callable[[DataFrame], DataFrame] | None) -> int | None:
    spark, year = df.sparkSession, F.year("date_of_admission")
    parts, n, written = [df], files, 0
    if keys:
        rows = df.count()                            # of a stored table: its footers only
        n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // SORTED_ROWS))
        dynamic = mode == "overwrite" and spark.conf.get(
            "spark.sql.sources.partitionOverwriteMode", "static").lower() == "dynamic"
        if mode != "ignore" and not dynamic and passes(rows) > 1:
            parts = [df.where(c) for c in runs(df, [year, *keys], passes(rows), rows)]
    for i, out in enumerate(parts):
        if keys:
            out = out.repartitionByRange(-(-n // len(parts)), year, *keys)
            out = out.withColumn("admission_year", year).sortWithinPartitions("admission_year", *keys)
        else:
            out = out.withColumn("admission_year", year)
        if finish is not None:
            out = finish(out)
        seen = Observation()
        if count:
            out = out.observe(seen, F.count(F.lit(1)).alias("n"))
        try:
            out.write.mode("append" if i else mode).option("compression", CODEC) \
                .partitionBy("admission_year").parquet(path)
        except Exception:
            if i and mode == "overwrite":
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            raise
        written += seen.get["n"] if count else 0
    return written if count else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S4: the stored admissions table."""
    return spark.read.parquet(path)
