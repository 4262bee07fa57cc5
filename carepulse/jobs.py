"""Batch and streaming jobs for ``spark-submit`` (via ``run_job.py``).

    spark-submit --py-files carepulse.zip run_job.py import   --csv s3://raw/admissions/ --table s3://lake/admissions
    spark-submit --py-files carepulse.zip run_job.py marts    --table s3://lake/admissions --out s3://lake/marts [--years 2023 2024]
    spark-submit --py-files carepulse.zip run_job.py analyse  --table s3://lake/admissions --key r05_monthly_trend --out s3://lake/r05
    spark-submit --py-files carepulse.zip run_job.py intake   --source s3://landing/admissions/ --sink s3://lake/flags \\
          --checkpoint s3://lake/_chk/intake

The session comes from the cluster (``SparkSession.builder.getOrCreate()``);
its settings, including ``spark.checkpoint.dir``, are read; while a job writes a
table or starts a stream, shuffle files are told to go with their query.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import DEFAULTS
from .session import ensure_checkpoint_dir


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("carepulse").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def import_csv(spark: SparkSession, csv: str, table: str, date_format: str = "yyyy-MM-dd",
               fold_case: bool = False, rejects: str | None = None) -> dict[str, int]:
    """S1 + S2 + S3: raw CSV -> typed, standardised, year-partitioned Parquet, and
    the values that could not be read (``<table>_rejects`` unless named)."""
    from .sources.schema import import_admissions
    return import_admissions(spark, csv, table, rejects or f"{table.rstrip('/')}_rejects", date_format, fold_case)


def marts(spark: SparkSession, table: str, out: str, years=None) -> list[str]:
    """S5 / S6: (re)write the dashboard marts from the stored table."""
    from .sources.marts import refresh_marts
    from .sources.schema import read_table, with_derived
    adm = with_derived(read_table(spark, table))
    return refresh_marts(adm, out, DEFAULTS, years=tuple(years) if years else None)


def analyse(spark: SparkSession, table: str, key: str, out: str) -> list[str]:
    """Run one analysis (or every one, ``key='all'``) over the stored table
    and write each result; with ``all`` each key goes to ``out/<key>``."""
    from .plans.registry import ANALYSES
    from .sources.schema import read_table, with_derived
    adm = with_derived(read_table(spark, table))
    keys = list(ANALYSES) if key == "all" else [key]
    written = []
    for k in keys:
        path = f"{out.rstrip('/')}/{k}" if key == "all" else out
        ANALYSES[k](adm, DEFAULTS).write.mode("overwrite").parquet(path)
        written.append(path)
    return written


def intake(spark: SparkSession, source: str, sink: str, checkpoint: str,
           available_now: bool = False, redelivery: str = "7 days"):
    """X1: score admissions arriving as Parquet files and append the flagged ones,
    each once however often its file arrives within ``redelivery``."""
    from .streaming.intake import admissions_stream, start_risk_intake
    from .sources.schema import with_admission_id
    stream = with_admission_id(admissions_stream(spark, source))
    return start_risk_intake(stream, sink, checkpoint, DEFAULTS, available_now=available_now, redelivery=redelivery)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="carepulse.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("import")
    p.add_argument("--csv", required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--date-format", default="yyyy-MM-dd")
    p.add_argument("--fold-case", action="store_true")
    p.add_argument("--rejects", help="where rejected values go (default: <table>_rejects)")
    p = sub.add_parser("marts")
    p.add_argument("--table", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--years", nargs=2, type=int)
    p = sub.add_parser("analyse")
    p.add_argument("--table", required=True)
    p.add_argument("--key", required=True, help="an analysis key, or 'all'")
    p.add_argument("--out", required=True)
    p = sub.add_parser("intake")
    p.add_argument("--source", required=True)
    p.add_argument("--sink", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--available-now", action="store_true")
    p.add_argument("--redelivery", default="7 days", help="how long a redelivered admission is known")
    a = ap.parse_args(argv)
    spark = _session()
    if a.cmd == "import":
        counts = import_csv(spark, a.csv, a.table, a.date_format, a.fold_case, a.rejects)
        print(", ".join(f"{k} {v}" for k, v in counts.items()))
    elif a.cmd == "marts":
        marts(spark, a.table, a.out, a.years)
    elif a.cmd == "analyse":
        analyse(spark, a.table, a.key, a.out)
    else:
        q = intake(spark, a.source, a.sink, a.checkpoint, a.available_now, a.redelivery)
        q.awaitTermination()


if __name__ == "__main__":
    main()
