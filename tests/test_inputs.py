"""Inputs that the clean fixture lacks: NULLs in every column, a month without
admissions, unknown conditions, swapped headers, windows of any length."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.plans import advanced, revenue
from carepulse.plans.registry import ALL
from carepulse.session import ensure_checkpoint_dir
from carepulse.sources import marts
from carepulse.sources.schema import (COLUMNS, SCHEMA, read_admissions, read_rejects, standardise,
                                      with_admission_id, write_admissions)
from carepulse.streaming.intake import admissions_stream, review_check
from conftest import SF01
from oracle_compare import compare, duck
from test_sources import HEADERS


@pytest.fixture(scope="module")
def dirty_dir():
    d = tempfile.mkdtemp(prefix="carepulse-dirty-", dir="/tmp")
    con = duckdb.connect()

    def null(c, every, key):
        return f"CASE WHEN {key} % {every} = 0 THEN NULL ELSE {c} END AS {c}"
    changed = {
        "region": "", "nation": "", "supplier": "",
        "customer": ", ".join(null(c, k, "c_custkey") for c, k in (
            ("c_mktsegment", 17), ("c_nationkey", 19), ("c_name", 23))),
        "part": "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'UNHEARD OF' "
                "ELSE p_type END AS p_type",
        "orders": null("o_orderpriority", 29, "o_orderkey"),
        "lineitem": ", ".join(null(c, k, "l_orderkey") for c, k in (
            ("l_extendedprice", 31), ("l_returnflag", 37), ("l_quantity", 43)))
            + ", CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN strftime(l_shipdate, '%Y-%m') = '1996-03' "
              "THEN l_shipdate + INTERVAL 2 YEAR ELSE l_shipdate END AS l_shipdate",
        "events": ", ".join(null(c, k, "event_id") for c, k in (("user_id", 7), ("ts", 53))),
    }
    for t, cols in changed.items():
        con.execute(f"COPY (SELECT * {f'REPLACE ({cols})' if cols else ''} FROM read_parquet('{SF01}/{t}.parquet')) "
                    f"TO '{d}/{t}.parquet' (FORMAT PARQUET)")
    return d


@pytest.mark.parametrize("key", sorted(ALL))
def test_dirty_tables_match_oracle(spark, dirty_dir, key):
    res = compare(spark, dirty_dir, [key], con=duck(dirty_dir), verbose=False)[key]
    assert res["ok"], res


def test_matrix_rows_add_up(spark, adm01):
    odd = adm01.withColumn("medical_condition", F.when(F.col("age") % 3 == 0, F.lit(None)).when(
        F.col("age") % 3 == 1, F.lit("unheard of")).otherwise(F.col("medical_condition")))
    m = revenue.r11_insurer_condition_matrix(odd, FIXTURE).toPandas()
    parts = m[[*FIXTURE.condition_values, "other"]].sum(axis=1)
    assert (abs(parts - m["insurer_total"]) < 0.05).all() and (m["other"] > 0).all()


def test_top_entity_ignores_missing_revenue(spark, adm01):
    rows = adm01.limit(0).unionByName(adm01.limit(3).withColumns({
        "hospital": F.element_at(F.array(F.lit("H5"), F.lit("Hnull"), F.lit("H1")),
                                 (F.monotonically_increasing_id() + 1).cast("int")),
        "billing_amount": F.element_at(F.array(F.lit(5000), F.lit(None), F.lit(10)),
                                       (F.monotonically_increasing_id() + 1).cast("int")).cast("decimal(18,2)")}))
    assert advanced.a06_executive_summary(rows, FIXTURE).first()["top_hospital"] == "H5"


@pytest.mark.parametrize("hours", [4, 24, 48, 100])
def test_review_window_of_any_length(spark, hours):
    con = duckdb.connect()
    ev = con.execute(f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id % 40 END AS user_id,
        event_type, ts FROM read_parquet('{SF01}/events.parquet')
        WHERE event_type IN ('signup', 'view') AND event_id % 3 = 0""").df()
    exp = con.execute(f"""SELECT s.event_id, count(v.event_id) > 0 AS reviewed FROM ev s LEFT JOIN ev v
        ON v.user_id = s.user_id AND v.event_type = 'view' AND v.ts BETWEEN s.ts AND s.ts + INTERVAL {hours} HOUR
        WHERE s.event_type = 'signup' GROUP BY 1 ORDER BY 1""").fetchall()
    df = spark.read.parquet(f"{SF01}/events.parquet").where("event_type IN ('signup','view') AND event_id % 3 = 0") \
        .withColumn("user_id", F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id % 40 END"))
    got = review_check(df, FIXTURE.with_(review_within_hours=hours)).select("event_id", "reviewed") \
        .orderBy("event_id").collect()
    assert [tuple(r) for r in got] == exp


def _csv(rows, headers=HEADERS):
    d = tempfile.mkdtemp(prefix="carepulse-csv-", dir="/tmp")
    with open(f"{d}/a.csv", "w") as fh:
        fh.write(",".join(headers) + "\n" + "".join(",".join(r) + "\n" for r in rows))
    return d


ROW = dict(zip(HEADERS, ["Ann", "41", "Female", "AB+", "Asthma", "2020-01-31", "Dr Who", "St Mary", "Aetna",
                         "12.50", "7", "Elective", "2020-02-02", "Aspirin", "Normal"]))


def test_csv_is_bound_by_header(spark):
    order = HEADERS[::-1]
    got = read_admissions(spark, _csv([[ROW[h] for h in order]], order)).first()
    assert (got["age"], got["gender"], got["blood_type"]) == (41, "Female", "AB+")
    with pytest.raises(ValueError, match="missing"):
        read_admissions(spark, _csv([["1"]], ["Age"]))
    with pytest.raises(ValueError, match="unknown"):
        read_admissions(spark, _csv([[*ROW.values(), "x"]], [*HEADERS, "Extra"]))


def test_rejects_are_kept_apart(spark):
    bad = {**ROW, "Age": "old", "Date of Admission": "2020-13-45"}
    d = _csv([list(ROW.values()), list(bad.values()), ["only", "two"]])
    adm = read_admissions(spark, d)
    assert adm.count() == 3 and set(adm.columns) == {*COLUMNS, "admission_id"}
    rejects = {(r["column_name"], r["raw_text"]) for r in read_rejects(spark, d).collect()}
    assert rejects == {("age", "old"), ("date_of_admission", "2020-13-45"), ("line", "only,two")}


def test_fold_case_keeps_a_spelling_that_occurs(spark):
    rows = [{**ROW, "Hospital": h, "Insurance Provider": i} for h, i in (
        ("St Mary", "UnitedHealthcare"), ("ST MARY", "UNITEDHEALTHCARE"), ("St Mary", "UnitedHealthcare"))]
    got = read_admissions(spark, _csv([list(r.values()) for r in rows]), fold_case=True).collect()
    assert {(r["hospital"], r["insurance_provider"], r["blood_type"]) for r in got} == {
        ("St Mary", "UnitedHealthcare", "AB+")}


def test_admission_id_tells_null_from_value(spark):
    rows = [tuple("q" if c == "gender" else None for c in COLUMNS), tuple("q" if c == "blood_type" else None for c in COLUMNS)]
    df = spark.createDataFrame([r for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    ids = [r["admission_id"] for r in with_admission_id(df).collect()]
    assert len(set(ids)) == 2


def test_stream_schema_does_not_change_the_table_schema(spark):
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="carepulse-str-", dir="/tmp")
    admissions_stream(spark, d, T.StructType([T.StructField("more", T.StringType())]))
    assert len(SCHEMA.fields) == 15
    assert standardise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refreshed_marts_equal_a_rebuild(spark, adm01):
    pages = {"p": ("r05_monthly_trend", "d01_monthly_admissions", "e10_admission_type_dist")}
    a, b = (tempfile.mkdtemp(prefix="carepulse-marts-", dir="/tmp") for _ in range(2))
    old = adm01.where("year(date_of_admission) <> 1997 or day(date_of_admission) < 20")
    marts.write_marts(old, a, FIXTURE, pages)
    marts.write_marts(adm01, a, FIXTURE, pages, years=(1997, 2001))
    marts.write_marts(adm01, b, FIXTURE, pages)

    def read(d, k):
        return sorted(map(str, spark.read.parquet(f"{d}/p/{k}").collect()))
    for k in pages["p"]:
        assert read(a, k) == read(b, k)
    gone = adm01.where("year(date_of_admission) <> 1995")
    marts.write_marts(gone, a, FIXTURE, pages)
    assert spark.read.parquet(f"{a}/p/d01_monthly_admissions").where("year = 1995").count() == 0


def test_sliced_page_equals_the_sliced_fact(spark, adm01):
    from carepulse.functions.measures import evaluate
    d = tempfile.mkdtemp(prefix="carepulse-slices-", dir="/tmp")
    pre = spark.read.parquet(marts.write_slices(adm01, d))
    ctx = {"year": 1996, "gender": "Female", "admission_type": ["Emergency", "Urgent"]}
    got = marts.sliced_page(pre, ("hospital",), **ctx)
    names = ["total_patients", "total_revenue", "avg_billing", "avg_length_of_stay", "revenue_per_day"]
    exp = evaluate(adm01, names, by=["hospital"], where={**ctx, "admission_type": ["Emergency", "Urgent"]})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, exp.select(*got.columns).collect()), key=str)


def test_stored_table_has_bounded_files(spark, adm01):
    d = tempfile.mkdtemp(prefix="carepulse-tbl-", dir="/tmp")
    write_admissions(adm01.select(*COLUMNS).repartition(12), f"{d}/t", files=5)
    files = [f for _, _, fs in os.walk(f"{d}/t") for f in fs if f.endswith(".parquet")]
    years = [x for x in os.listdir(f"{d}/t") if x.startswith("admission_year=")]
    assert len(files) <= 5 + len(years)


def test_shared_folder_is_required_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_import_writes_table_and_rejects_that_add_up(spark):
    from carepulse import jobs
    bad = {**ROW, "Age": "old", "Date of Admission": "2020-13-45"}
    d = _csv([list(ROW.values()), list(bad.values()), ["only", "two"], list(ROW.values())])
    got = jobs.import_csv(spark, d, f"{d}-table")
    assert got == {"lines": 4, "rows": 4, "bad_lines": 2, "rejected": 3}
    assert spark.read.parquet(f"{d}-table").count() == 4
    rejects = {(r["column_name"], r["raw_text"]) for r in spark.read.parquet(f"{d}-table_rejects").collect()}
    assert rejects == {("age", "old"), ("date_of_admission", "2020-13-45"), ("line", "only,two")}
    # an import without rejects, and one of a file that holds the header only
    clean = _csv([list(ROW.values())])
    assert jobs.import_csv(spark, clean, f"{clean}-t", rejects=f"{clean}-r")["rejected"] == 0
    assert spark.read.parquet(f"{clean}-r").count() == 0


def test_import_fails_when_counts_differ(spark, monkeypatch):
    from carepulse.sources import schema
    real = schema.write_admissions

    def lossy(df, path, count=None, **kw):
        return real(df.where("age is not null"), path, count=count, **kw)
    monkeypatch.setattr(schema, "write_admissions", lossy)
    d = _csv([list(ROW.values()), list({**ROW, "Age": ""}.values())])
    with pytest.raises(schema.ImportMismatch):
        schema.import_admissions(spark, d, f"{d}-t", f"{d}-r")


def test_spellings_of_many_names_are_joined_and_few_replaced(spark, monkeypatch):
    from carepulse.sources import schema
    n = 2 * schema.FEW_SPELLINGS
    rows = [{**ROW, "Doctor": (f"Dr {i % n}" if i < 4 * n else f"DR {i % n}"),
             "Gender": "female" if i % 5 == 0 else "Female"} for i in range(5 * n)]
    raw = schema.read_raw(spark, _csv([list(r.values()) for r in rows]))
    joins = []
    real = schema.join_counted
    monkeypatch.setattr(schema, "join_counted", lambda *a, **k: joins.append(a[2]) or real(*a, **k))
    got = schema.standardise(raw, fold_case=True)
    assert joins == [["doctor"]]
    assert {r["doctor"] for r in got.select("doctor").collect()} == {f"Dr {i}" for i in range(n)}
    assert {r["gender"] for r in got.select("gender").collect()} == {"Female"}
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert tree.count("FileScan csv") == 1            # the dictionary was the other read


@pytest.mark.parametrize("a,xs", [(0.5, [0.01, 0.2, 1, 5, 30]), (1.5, [0.1, 2, 9]), (3.5, [0.5, 3, 4.4, 4.6, 12, 40]),
                                  (10.0, [1, 10, 25]), (60.5, [30, 61, 90]), (199.0, [150, 199, 260])])
def test_incomplete_gamma_equals_its_integral(spark, a, xs):
    """Against Simpson's rule on the density (in u = sqrt(t), which is smooth at 0)."""
    import math

    from carepulse.functions.exprs import gamma_q, log_gamma

    def integral(x):
        n = 40_000
        h = math.sqrt(x) / n

        def f(u):
            return 0.0 if u == 0 and a > 0.5 else 2 * math.exp((2 * a - 1) * math.log(u) - u * u - math.lgamma(a)) \
                if u else 2 / math.gamma(a)
        return 1 - h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", gamma_q(F.lit(a), F.col("x")).alias("q"), log_gamma(F.lit(a)).alias("lg")).collect():
        assert r["q"] == pytest.approx(integral(r["x"]), abs=1e-7)
        assert r["lg"] == pytest.approx(math.lgamma(a), rel=1e-12, abs=1e-12)


def test_chi_square_tail_of_odd_even_and_large_degrees(spark):
    from carepulse.plans.behaviour import chi_square_tail
    # fixed values of the published table: 5 % points, and far beyond both ends
    rows = [(3.841, 1, 0.05), (7.815, 3, 0.05), (9.488, 4, 0.05), (11.070, 5, 0.05), (43.773, 30, 0.05), (0.0, 3, 1.0),
            (-1e-9, 3, 1.0), (500.0, 3, 0.0), (1e6, 7, 0.0), (447.632, 399, 0.0466), (5.0, 0, None)]
    df = spark.createDataFrame([(float(x), k, p) for x, k, p in rows], "x double, k int, p double")
    for r in df.withColumn("q", chi_square_tail(F.col("x"), F.col("k"))).collect():
        assert r["q"] == r["p"] or r["q"] == pytest.approx(r["p"], abs=2e-4), r


def test_labels_of_missing_values(spark):
    from carepulse.functions.exprs import room_tier, trend_label
    df = spark.createDataFrame([(None, True), (None, False), (1.0, False), (-1.0, False), (0.0, False)],
                               "g double, first boolean")
    assert [r[0] for r in df.select(trend_label("g", "first")).collect()] == [
        "Baseline", "Unknown", "Growth", "Decline", "Flat"]
    assert [r[0] for r in df.select(room_tier("g")).collect()] == ["Unknown", "Unknown", "Moderate", "Low", "Low"]
