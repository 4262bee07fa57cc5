"""What the shared steps move: short rows, each once."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.plans import lifecycle, registry
from carepulse.sources import fixture, schema


@pytest.fixture
def moved(spark, monkeypatch):
    """(partitions, columns) of each range shuffle."""
    kind, seen = type(spark.range(0)), []

    def counted(self, *a, _f=kind.repartitionByRange) -> DataFrame:
        seen.append((a[0], self.columns))
        return _f(self, *a)
    monkeypatch.setattr(kind, "repartitionByRange", counted)
    return seen


@pytest.fixture
def tables(spark, tmp_path):
    """Two line items each of an order, with nulls in all that may be null."""
    def put(name, rows, types):
        spark.createDataFrame(rows, types).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", [(7, "C7", 12, "AUTO"), (8, None, None, None), (-3, "C3", -9, "AUTO")],
        "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    put("orders", [(1, 7, "2-HIGH"), (2, 8, None), (3, -3, "3-MEDIUM"), (4, 99, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderpriority string")
    put("part", [(5, "SMALL", 3), (6, None, None)], "p_partkey long, p_type string, p_size int")
    put("supplier", [(1, "S1"), (2, None)], "s_suppkey long, s_name string")
    put("lineitem", [(o, n, 5 + n % 2, 1 + n % 2, q, p, f, d) for o in (1, 2, 3, 4) for n, q, p, f, d in (
        (1, 50.0, 10.25, "N", "1996-02-28 00:00:00"), (2, None, None, None, None), (3, 3.0, 0.5, "A", "1997-12-31 00:00:00"))],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate string")
    return str(tmp_path)


def test_fixture_rows_spelled_out_equal_the_sql(spark, tables, moved):
    for t in ("customer", "orders", "part", "supplier", "lineitem"):
        spark.read.parquet(f"{tables}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(fixture.ADMISSIONS_SQL)
    got = fixture.fixture_admissions(spark, tables)
    assert got.columns == want.columns and got.count() == 9
    stored = registry.materialized_admissions(spark, tables).select(*want.columns)
    for df in (got, stored):
        assert [f.dataType for f in df.schema] == [f.dataType for f in got.schema]
        assert sorted(map(repr, df.collect())) == sorted(map(repr, want.select(
            *[F.col(f.name).cast(f.dataType) for f in got.schema]).collect()))
    # spelled out after the sort
    assert len(moved) == 1 and not {"gender", "blood_type", "doctor", "medication"} & set(moved[0][1])


def test_import_moves_no_id(adm01, moved):
    out = lifecycle.s1_csv_import(adm01.limit(50), FIXTURE)
    assert sum(r["total_patients"] for r in out.collect()) == 50
    assert len(moved) == 1 and "admission_id" not in moved[0][1]


def test_delivered_files_are_not_sorted_again(adm01, moved):
    rows = adm01.where("l_orderkey < 400")
    want = registry.ANALYSES["a08_review_queue"](rows, FIXTURE).count()
    assert lifecycle.x1_risk_flags(rows, FIXTURE).count() == want > 0 and not moved


def test_a_task_sorts_a_bounded_number_of_rows(adm01, moved, monkeypatch, tmp_path):
    monkeypatch.setattr(schema, "SORTED_ROWS", 50, raising=False)
    rows = adm01.limit(1000)
    schema.write_admissions(rows.select(*schema.COLUMNS), f"{tmp_path}/t")
    assert moved[0][0] == 20 and adm01.sparkSession.read.parquet(f"{tmp_path}/t").count() == 1000
