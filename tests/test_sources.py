"""Sources and sinks: CSV import with raw headers, standardisation, the
year-partitioned Parquet table with partition pruning, dashboard marts."""

import os
import tempfile

from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.functions.measures import slice_
from carepulse.sources import marts
from carepulse.sources.schema import COLUMNS, read_admissions, read_table, write_admissions

HEADERS = ["Name", "Age", "Gender", "Blood Type", "Medical Condition", "Date of Admission",
           "Doctor", "Hospital", "Insurance Provider", "Billing Amount", "Room Number",
           "Admission Type", "Discharge Date", "Medication", "Test Results"]


def test_csv_import_roundtrip(spark, adm01):
    d = tempfile.mkdtemp(prefix="carepulse-csv-", dir="/tmp")
    src = adm01.select(*COLUMNS)
    src.select(*[F.col(c).cast("string").alias(h) for c, h in zip(COLUMNS, HEADERS)]) \
       .write.option("header", True).csv(f"{d}/csv")
    # one malformed line: bad age and bad date become NULL, the row is kept
    with open(f"{d}/csv/zz-bad.csv", "w") as fh:
        fh.write(",".join(HEADERS) + "\n")
        fh.write("x,notanumber,Male,A+,Asthma,2020-13-45,d,h,Aetna,12.5,1,Elective,2020-01-02,"
                 "Aspirin,Normal\n")
    got = read_admissions(spark, f"{d}/csv")
    assert got.count() == src.count() + 1
    bad = got.where("name = 'x'").first()
    assert bad["age"] is None and bad["date_of_admission"] is None
    good = got.where("name <> 'x'").select(*COLUMNS)
    assert good.exceptAll(src).count() == 0
    assert "admission_id" in got.columns


def test_partitioned_table_prunes_years(spark, adm01):
    d = tempfile.mkdtemp(prefix="carepulse-tbl-", dir="/tmp")
    write_admissions(adm01.select(*COLUMNS), f"{d}/t")
    t = read_table(spark, f"{d}/t")
    assert len([p for p in os.listdir(f"{d}/t") if p.startswith("admission_year=")]) == 7
    sliced = slice_(t, year_range=(1996, 1997), admission_type="Emergency")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(admission_year" in plan
    assert "PushedFilters: [" in plan and "EqualTo(admission_type,Emergency)" in plan
    assert sliced.count() == slice_(adm01, year_range=(1996, 1997), admission_type="Emergency").count()


def test_marts_write_and_partial_refresh(spark, adm01):
    d = tempfile.mkdtemp(prefix="carepulse-marts-", dir="/tmp")
    paths = marts.write_marts(adm01, d, FIXTURE)
    assert len(paths) == 12
    assert marts.write_slices(adm01, d).endswith('slices')
    monthly = spark.read.parquet(f"{d}/revenue_deep_dive/r05_monthly_trend")
    assert monthly.count() == 83
    before = monthly.where("year = 1995").orderBy("month").collect()
    refreshed = marts.refresh_marts(adm01, d, FIXTURE, years=(2000, 2001))
    assert len(refreshed) == 12 + len(marts.CELLS)
    after = spark.read.parquet(f"{d}/revenue_deep_dive/r05_monthly_trend")
    assert after.count() == 83                     # other years kept (dynamic overwrite)
    assert after.where("year = 1995").orderBy("month").collect() == before
