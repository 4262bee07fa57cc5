"""The spark-submit entry points, end to end on local folders: CSV import ->
stored table -> one analysis and the marts; the intake stream over the table."""

import tempfile

from pyspark.sql import functions as F

from carepulse import jobs
from carepulse.plans.registry import ANALYSES
from carepulse.sources.schema import COLUMNS
from test_sources import HEADERS


def test_jobs_end_to_end(spark, adm01):
    d = tempfile.mkdtemp(prefix="carepulse-jobs-", dir="/tmp")
    adm01.select(*[F.col(c).cast("string").alias(h) for c, h in zip(COLUMNS, HEADERS)]) \
        .write.option("header", True).csv(f"{d}/csv")
    jobs.main(["import", "--csv", f"{d}/csv", "--table", f"{d}/table"])
    t = spark.read.parquet(f"{d}/table")
    assert t.count() == adm01.count()
    jobs.main(["analyse", "--table", f"{d}/table", "--key", "r05_monthly_trend",
               "--out", f"{d}/r05"])
    assert spark.read.parquet(f"{d}/r05").count() == 83
    written = jobs.analyse(spark, f"{d}/table", "all", f"{d}/all")
    assert len(written) == len(ANALYSES)
    assert spark.read.parquet(f"{d}/all/a06_executive_summary").count() == 1
    jobs.main(["marts", "--table", f"{d}/table", "--out", f"{d}/marts"])
    assert spark.read.parquet(f"{d}/marts/executive_overview/a06_executive_summary").count() == 1
    jobs.main(["intake", "--source", f"{d}/table", "--sink", f"{d}/flags",
               "--checkpoint", f"{d}/chk", "--available-now"])
    assert spark.read.parquet(f"{d}/flags").count() > 0
