"""What the jobs keep on the disks while they run: the shuffle files of one pass,
no input that was taken in."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.plans import lifecycle, registry
from carepulse.sources import fixture, schema
from carepulse.streaming import intake


def shuffled(spark) -> set[str]:
    """Names of the shuffle files on this machine's disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (blocks.apply(i).getName() for i in range(blocks.size())) if n.startswith("shuffle_")}


def kept(spark, before: set[str]) -> set[str]:
    """Shuffle files that were not there before and do not go (Spark removes them in the background)."""
    until = time.time() + 5
    while (new := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return new


@pytest.fixture
def odd(spark, tmp_path):
    """1,200 stored admissions; null dates and hospitals, one hospital with half of all."""
    i = F.col("id")
    rows = spark.range(1200).select(
        i.cast("string").alias("name"),
        F.when(i % 11 > 0, F.date_add(F.lit("1994-11-01").cast("date"), (i * 7 % 900).cast("int"))).alias("date_of_admission"),
        F.when(i % 2 == 0, "H").when(i % 13 > 0, F.concat(F.lit("h"), i % 40)).alias("hospital"),
        (i / 4).cast("decimal(18,2)").alias("billing_amount"))
    full = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.SCHEMA]
    rows.select(*full).write.parquet(f"{tmp_path}/odd")
    return spark.read.parquet(f"{tmp_path}/odd")


def _texts(df):
    return sorted(map(repr, df.select(*schema.COLUMNS).collect()))


def test_each_row_is_in_one_run(odd):
    keys = [F.year("date_of_admission"), F.col("hospital"), F.col("date_of_admission")]
    for ks, most in ((keys, 6), (keys[:1], 6), ([F.lit(1)], 2)):
        cuts = schema.runs(odd, ks, 6, 1200)
        assert 1 <= len(cuts) <= most
        met = sum((F.coalesce(c.cast("int"), F.lit(99)) for c in cuts), F.lit(0))
        assert odd.where(met != 1).count() == 0
    parts = [odd.where(c).count() for c in schema.runs(odd, keys, 6, 1200)]
    assert len(parts) == 6 and max(parts) < 400
    assert len(schema.runs(odd.limit(0), keys, 6, 0)) == 1


def test_a_table_in_passes_is_the_table(spark, odd, tmp_path, monkeypatch):
    schema.write_admissions(odd, f"{tmp_path}/whole", files=8)
    monkeypatch.setattr(schema, "PASS_ROWS", 300)
    spark.range(3).select(F.lit("old").alias("name"), F.lit(1901).alias("admission_year")) \
        .write.partitionBy("admission_year").parquet(f"{tmp_path}/t")
    before = shuffled(spark)
    assert schema.write_admissions(odd, f"{tmp_path}/t", files=8, count=True, finish=schema.with_admission_id) == 1200
    assert not kept(spark, before)
    t = spark.read.schema("admission_id string, " + odd._jdf.schema().toDDL()).parquet(f"{tmp_path}/t")
    assert _texts(t) == _texts(odd) and t.where("admission_id is null").count() == 0
    whole, cut = (glob.glob(f"{tmp_path}/{x}/*/*.parquet") for x in ("whole", "t"))
    assert len(cut) <= 8 + 4 + 4
    assert {os.path.basename(os.path.dirname(f)) for f in whole} == {os.path.basename(os.path.dirname(f)) for f in cut}
    # a file holds a range of hospitals, and no two files of a year the same rows
    spans = t.where("date_of_admission is not null").groupBy(F.input_file_name().alias("f"), F.year("date_of_admission").alias("y")).agg(
        F.min(F.struct("hospital", "date_of_admission")).alias("lo"), F.max(F.struct("hospital", "date_of_admission")).alias("hi"))
    a, b = spans.alias("a"), spans.alias("b")
    assert a.join(b, F.expr("a.y = b.y and a.f <> b.f and a.lo < b.hi and b.lo < a.hi")).count() == 0
    assert schema.write_admissions(odd, f"{tmp_path}/t", mode="append", files=8, count=True) == 1200
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2400


def test_a_failed_pass_leaves_no_half_table(odd, tmp_path, monkeypatch):
    monkeypatch.setattr(schema, "PASS_ROWS", 300)
    late = schema.runs(odd, [F.year("date_of_admission"), F.col("hospital")], 4, 1200)[-1]
    bad = lambda df: df.withColumn("x", F.when(late, F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        schema.write_admissions(odd, f"{tmp_path}/t", cluster_by=("hospital",), finish=bad)
    assert not os.path.exists(f"{tmp_path}/t")


def test_the_fixture_in_parts_is_the_fixture(spark, tmp_path, monkeypatch):
    for t in ("customer", "orders", "part", "supplier"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.unionByName(li.limit(5)).unionByName(li.limit(5).withColumn("l_orderkey", F.lit(None).cast("long"))) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = fixture.fixture_admissions(spark, str(tmp_path))
    monkeypatch.setattr(schema, "PASS_ROWS", 1500)
    seen, real = [], registry.fixture_rows
    monkeypatch.setattr(registry, "fixture_rows", lambda s, d, part: seen.append((part, real(s, d, part).count())) or real(s, d, part))
    stored = registry.materialized_admissions(spark, str(tmp_path))
    assert [p for p, _ in seen] == [(i, len(seen)) for i in range(len(seen))] and len(seen) >= 4
    assert max(n for _, n in seen) < whole.count() / 2
    assert sorted(map(repr, stored.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.fixture
def folders(spark, monkeypatch):
    made, real = [], lifecycle._folder
    monkeypatch.setattr(lifecycle, "_folder", lambda s: made.append(real(s).removeprefix("file:")) or made[-1])
    return made


def test_the_import_in_passes_leaves_no_csv(spark, adm01, folders, monkeypatch):
    rows = adm01.limit(900)
    rows.write.mode("overwrite").parquet(f"{lifecycle._folder(spark)}/rows")
    rows = spark.read.parquet(f"{folders[0]}/rows")
    want = sorted(map(repr, lifecycle.s1_csv_import(rows, FIXTURE).collect()))
    monkeypatch.setattr(schema, "PASS_ROWS", 200)
    before = shuffled(spark)
    out = lifecycle.s1_csv_import(rows, FIXTURE)
    assert not kept(spark, before)
    assert sorted(map(repr, out.collect())) == want
    assert sorted(x for x in os.listdir(folders[-1]) if x[0] != ".") == ["rejects", "table"]


def test_the_intake_keeps_no_input_and_no_shuffle(spark, adm01, folders):
    rows = adm01.where("l_orderkey < 400")
    want = registry.ANALYSES["a08_review_queue"](rows, FIXTURE).count()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    before = shuffled(spark)
    try:
        out = lifecycle.x1_risk_flags(rows, FIXTURE)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert not kept(spark, before)
    assert out.count() == want > 0
    assert sorted(x for x in os.listdir(folders[0]) if x[0] != ".") == ["chk", "flags"]
    assert "RocksDB" in _provider(folders[0])
    # no more stores than the ids need: each allots some MB
    assert len(os.listdir(f"{folders[0]}/chk/state/0")) <= spark.sparkContext.defaultParallelism + 1


def _provider(folder: str) -> str:
    with open(f"{folder}/chk/offsets/0") as f:
        return json.loads(f.read().split("\n")[1])["conf"][intake._PROVIDER]


def test_a_checkpoint_keeps_its_store(spark, adm01, tmp_path, monkeypatch):
    """Begun with ids in the heap, goes on with them; a session's own choice holds."""
    keys = list(FIXTURE.row_keys)
    rows = adm01.where("l_orderkey < 300").select(*keys, *schema.COLUMNS)

    def deliver(to):
        rows.coalesce(3).write.mode("append").parquet(f"{to}/in")
        stream = intake.admissions_stream(spark, f"{to}/in", rows.select(*keys).schema, max_bytes_per_trigger=1)
        intake.start_risk_intake(stream, f"{to}/flags", f"{to}/chk", FIXTURE, available_now=True).awaitTermination()
        return spark.read.parquet(f"{to}/flags").count()
    monkeypatch.setattr(intake, "STATE", {})
    want = deliver(tmp_path)
    assert want == intake.risk_flags(rows, FIXTURE).count() > 0 and "HDFS" in _provider(tmp_path)
    monkeypatch.undo()
    assert deliver(tmp_path) == want and "HDFS" in _provider(tmp_path)
    assert deliver(f"{tmp_path}/new") == want and "RocksDB" in _provider(f"{tmp_path}/new")
    assert "HDFS" in spark.conf.get(intake._PROVIDER)
