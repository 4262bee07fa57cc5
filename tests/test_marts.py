"""Marts: every visual from the stored cells, refreshes of single years against
full rebuilds, slicers answered without the fact."""

import re
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.functions.measures import slice_
from carepulse.plans import dashboard
from carepulse.plans.registry import ANALYSES
from carepulse.sources import marts
from carepulse.sources.schema import COLUMNS, read_table, with_derived, write_admissions
from test_plans import executions

KEYS = [k for ks in marts.PAGES.values() for k in ks]


def folder():
    return tempfile.mkdtemp(prefix="carepulse-marts-", dir="/tmp")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def fact(spark, adm01):
    """The admissions as a stored table, with rows without dates, amounts and names."""
    odd = adm01.limit(40).withColumns({
        "date_of_admission": F.when(F.col("room_number") % 2 == 0, F.col("date_of_admission")),
        "billing_amount": F.lit(None).cast("decimal(18,2)"), "hospital": F.lit(None).cast("string"),
        "medical_condition": F.lit(None).cast("string"), "doctor": F.lit(None).cast("string")})
    path = f"{folder()}/t"
    write_admissions(adm01.select(*COLUMNS).unionByName(odd.select(*COLUMNS)), path)
    return with_derived(read_table(spark, path))


@pytest.fixture(scope="module")
def built(fact):
    d = folder()
    marts.refresh_marts(fact, d, FIXTURE)
    return d


@pytest.mark.parametrize("key", KEYS)
def test_visual_equals_its_analysis(spark, fact, built, key):
    page = next(p for p, ks in marts.PAGES.items() if key in ks)
    got = spark.read.parquet(f"{built}/{page}/{key}")
    want = ANALYSES[key](fact, FIXTURE)
    assert rows(got.select(*want.columns)) == rows(want)
    assert dict(got.select(*want.columns).dtypes) == dict(want.dtypes)


def scans(spark, fact, call) -> list[str]:
    """The descriptions of the fact's scans in the executed plans that a call starts."""
    path = re.search(r"(/tmp/\S+?/t)/", fact.inputFiles()[0]).group(1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    out = []
    for text in executions(spark, call, whole=True):
        tree = text.split("== Initial Plan ==")[0].split("\n\n")[0]
        for node in re.findall(r"Scan parquet +\((\d+)\)", tree):
            detail = re.search(rf"\n\({node}\) Scan parquet.*?(?=\n\(\d+\) )", text, re.S).group(0)
            if f"{path}]" in detail:
                out.append(detail)
    return out


def test_all_visuals_take_two_scans_of_the_fact(spark, fact):
    class Run:
        def collect(self):
            return marts.write_marts(fact, folder(), FIXTURE)
    assert len(scans(spark, fact, Run)) == 2


def test_refresh_of_some_years_equals_a_rebuild(spark, fact):
    """The first, a middle and the last year change, then a range: amounts, a
    month that goes and a year that goes."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    small = fact.where("pmod(hash(name), 6) = 0 or hospital is null").coalesce(2)
    y, a = F.year("date_of_admission"), folder()
    marts.refresh_marts(small, a, FIXTURE)
    try:
        now = small
        for years in ((1992, 1992), (1995, 1995), (1998, 1998), (1993, 1996)):
            inside = F.coalesce(y.between(*years), F.lit(False))
            now = now.withColumn("billing_amount", F.when(
                inside, (F.col("billing_amount") * 10).cast("decimal(18,2)")).otherwise(F.col("billing_amount")))
            now = now.where(~inside | (F.month("date_of_admission") != 5) & (y != 1994))
            marts.refresh_marts(now, a, FIXTURE, years=years)
            for key in ("r05_monthly_trend", "d01_monthly_admissions", "a06_executive_summary", "o09_doctor_bar"):
                page = next(p for p, ks in marts.PAGES.items() if key in ks)
                want = ANALYSES[key](now, FIXTURE)
                assert rows(spark.read.parquet(f"{a}/{page}/{key}").select(*want.columns)) == rows(want), (key, years)
        b = folder()
        marts.refresh_marts(now, b, FIXTURE)
        for name in [f"{p}/{k}" for p, ks in marts.PAGES.items() for k in ks] + ["slices", "doctors", "stays", "billing"]:
            assert rows(spark.read.parquet(f"{a}/{name}")) == rows(spark.read.parquet(f"{b}/{name}")), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_refresh_reads_the_changed_years_only(spark, fact, built):
    class Run:
        def collect(self):
            return marts.refresh_marts(fact, built, FIXTURE, years=(1996, 1996))
    found = scans(spark, fact, Run)
    assert len(found) == len(marts.CELLS)
    assert all("PartitionFilters: [isnotnull(admission_year" in t for t in found)


def test_a_mart_that_was_never_written_is_written_whole(spark, fact):
    d = folder()
    marts.refresh_marts(fact, d, FIXTURE, years=(1996, 1996))
    for key in ("r05_monthly_trend", "d01_monthly_admissions"):
        page = next(p for p, ks in marts.PAGES.items() if key in ks)
        assert spark.read.parquet(f"{d}/{page}/{key}").count() == ANALYSES[key](fact, FIXTURE).count()


# ------------------------------------------------------------------ slicers
CONTEXTS = [{}, {"gender": "Female", "medical_condition": ["Asthma", "Cancer"], "year": 1996},
            {"year_range": (1993, 1995), "insurance_provider": "Aetna", "admission_type": ["Emergency", "Urgent"]},
            {"year": 1997, "admission_type": "Elective"}, {"year": 1890}]


def some_contexts(fact):
    """The contexts with values that occur in the table."""
    v = fact.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in
                   ("gender", "medical_condition", "insurance_provider", "admission_type", "hospital")]).first()
    out = []
    for ctx in CONTEXTS:
        out.append({k: (v[k][:2] if isinstance(x, list) else v[k][0]) if k in v.asDict() else x for k, x in ctx.items()})
    return [*out, {"hospital": v["hospital"][3], "year_range": (1992, 1998)}]


@pytest.mark.parametrize("by", [(), ("medical_condition",), ("hospital", "gender")])
def test_statistics_under_slicers_without_the_fact(spark, fact, built, by):
    cells = {n: marts.read_cells(spark, built, n) for n in marts.CELLS}
    for ctx in some_contexts(fact):
        part = slice_(fact, **ctx).select(*by, "billing_amount", "length_of_stay", "doctor", "hospital").toPandas()
        con = duckdb.connect()
        con.register("part", part.astype({"billing_amount": "float64"}))
        group = f"GROUP BY {', '.join(by)}" if by else ""
        names = "".join(f"{c}, " for c in by)
        want = {tuple(r[:len(by)]): r[len(by):] for r in con.execute(f"""SELECT {names}
            quantile_cont(length_of_stay, 0.25), quantile_cont(length_of_stay, 0.5), quantile_cont(length_of_stay, 0.75),
            quantile_cont(billing_amount, 0.25), quantile_cont(billing_amount, 0.5), quantile_cont(billing_amount, 0.75),
            count(DISTINCT doctor), count(DISTINCT hospital) FROM part {group}""").fetchall()}
        stay = {tuple(r[:len(by)]): r[len(by):] for r in marts.sliced_median_stay(cells["stays"], by, **ctx).collect()}
        bill = {tuple(r[:len(by)]): r[len(by):] for r in
                marts.sliced_billing_percentiles(cells["billing"], by, **ctx).collect()}
        docs = {tuple(r[:len(by)]): r[-1] for r in marts.sliced_distinct_doctors(cells["people"], by, **ctx).collect()}
        # the fixture's NULL hospitals stand in no slices column for the patients counted here
        hosp = {tuple(r[:len(by)]): r[-1] for r in marts.sliced_distinct_hospitals(cells["slices"], by, **ctx).collect()}
        for k, w in want.items():
            def key(d, k=k):
                return d.get(k) or d.get(tuple(None if x != x else x for x in k))
            if w[1] is not None and w[1] == w[1]:
                assert list(key(stay)) == pytest.approx(w[:3], abs=0.005), (ctx, k)
            if w[4] is not None and w[4] == w[4]:
                assert list(key(bill)) == pytest.approx(w[3:6], rel=1.0001 * 0.01, abs=0.01), (ctx, k)
            assert abs((key(docs) or 0) - w[6]) <= 0.07 * w[6] + 1, (ctx, k)
            assert (key(hosp) or 0) == w[7], (ctx, k)


def test_ranks_under_slicers_without_the_fact(spark, fact, built):
    ctx = dict(FIXTURE.slice_example)
    for name, key, analysis in (("slices", "hospital", dashboard.d05_hospital_rank_sliced),
                                ("doctors", "doctor", dashboard.d06_doctor_rank_sliced)):
        cells = marts.read_cells(spark, built, name)
        assert rows(marts.sliced_ranks(cells, key, FIXTURE, **ctx)) == rows(analysis(fact, FIXTURE))
    with pytest.raises(ValueError):
        marts.sliced_ranks(marts.read_cells(spark, built, "doctors"), "doctor", gender="Female")


def test_buckets_hold_their_error(spark):
    from carepulse.operators.quantiles import BUCKET_ERROR, bucket_value, log_bucket
    vals = [0.0, 1e-12, 0.01, -0.01, 1.0, 123.45, -99999.99, 1e12, 8.5e15]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    got = df.select("v", bucket_value(log_bucket(F.col("v"))).alias("e")).collect()
    for r in got:
        if r["v"] is None:
            assert r["e"] is None
        else:
            assert abs(r["e"] - r["v"]) <= BUCKET_ERROR * abs(r["v"]) * (1 + 1e-9) + 1e-9
    order = df.where("v is not null").select("v", log_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r["b"] for r in order] == sorted(r["b"] for r in order)
