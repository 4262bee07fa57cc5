"""Structured Streaming intake: X1 (risk flags on arrival) and X2 (no review
within the window), each run with ``availableNow`` over several micro-batches
and compared with its batch form."""

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from carepulse.config import FIXTURE
from carepulse.streaming import intake
from conftest import SF01


def _scratch():
    return tempfile.mkdtemp(prefix="carepulse-stream-", dir="/tmp")


def test_x1_risk_flags_stream_equals_batch(spark, adm01):
    d = _scratch()
    keys = list(FIXTURE.row_keys)
    src = adm01.drop("length_of_stay", "admission_month", "admission_year")
    # the admissions arrive as five files, in admission order
    src.withColumn("_f", F.ntile(5).over(
        Window.orderBy("date_of_admission", *keys))) \
        .repartition(5, "_f").drop("_f").write.parquet(f"{d}/in")
    extra = spark.read.parquet(f"{d}/in").select(*keys).schema
    stream = intake.admissions_stream(spark, f"{d}/in", extra_schema=extra, max_files_per_trigger=2)
    q = intake.start_risk_intake(stream, f"{d}/out", f"{d}/ckpt", FIXTURE, available_now=True)
    q.awaitTermination()
    got = spark.read.parquet(f"{d}/out")
    exp = intake.risk_flags(adm01, FIXTURE)
    assert got.count() == exp.count() == 24032
    assert got.exceptAll(exp.select(*got.columns)).count() == 0


import pytest


@pytest.mark.parametrize("tz,hours", [("UTC", 4), ("America/New_York", 4), ("UTC", 48)])
def test_x2_stream_equals_batch(spark, tz, hours):
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        _x2_stream_equals_batch(spark, hours)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)


def _x2_stream_equals_batch(spark, hours):
    """Over several micro-batches, one user with a third of all events."""
    d = _scratch()
    cfg = FIXTURE.with_(review_within_hours=hours)
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
    # five time-ordered files, then a far-future sentinel that moves the
    # watermark past every real deadline (an outer/timeout result is final only
    # once the watermark passes it)
    # written one after another: the file source reads files in modification
    # order, and the watermark treats rows older than it as late
    chunks = ev.withColumn("_f", F.ntile(5).over(Window.orderBy("ts")))
    for i in range(1, 6):
        chunks.where(F.col("_f") == i).drop("_f").coalesce(1) \
              .write.mode("append").parquet(f"{d}/in")
    sentinel = spark.createDataFrame(
        [(-1, -1, "view")], "event_id long, user_id long, event_type string") \
        .select("event_id", F.to_timestamp_ntz(F.lit("2099-01-01 00:00:00")).alias("ts"),
                "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    sentinel.write.mode("append").parquet(f"{d}/in")

    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(f"{d}/in")
    out = intake.unreviewed_stream(stream, cfg)
    q = (out.writeStream.format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r[0] for r in spark.read.parquet(f"{d}/out").select("event_id").collect()}
    batch = intake.review_check(ev, cfg)
    exp = {r[0] for r in batch.where("NOT reviewed").select("event_id").collect()}
    assert 0 < len(exp) < 2017
    assert got == exp


def test_x2_late_review_beyond_watermark_is_dropped(spark):
    """Files arrive in order: (1) signups, (2) an event four hours later that
    moves the watermark, (3) two reviews - one for a signup whose deadline the
    watermark has passed (late: dropped, so that signup is reported) and one
    within the allowed lateness (kept, so that signup is not reported)."""
    d = _scratch()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t = lambda s: F.to_timestamp_ntz(F.lit(f"2024-01-01 {s}"))

    def write(rows):
        df = spark.createDataFrame([(i, u, k) for i, u, k, _ in rows],
                                   "event_id long, user_id long, event_type string")
        ts = F.when(F.lit(False), None)
        for i, _, _, s in rows:
            ts = ts.when(F.col("event_id") == i, t(s))
        df.select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"),
                  F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(f"{d}/in")

    write([(1, 1, "signup", "10:00:00"), (2, 2, "signup", "14:00:00"),
           (3, 3, "signup", "09:00:00"), (4, 3, "view", "09:30:00")])
    write([(5, 9, "click", "16:00:00")])
    write([(6, 1, "view", "10:30:00"), (7, 2, "view", "15:30:00")])
    spark.createDataFrame([(8, 9, "view")], "event_id long, user_id long, event_type string") \
        .select("event_id", F.to_timestamp_ntz(F.lit("2099-01-01 00:00:00")).alias("ts"),
                "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props")) \
        .write.mode("append").parquet(f"{d}/in")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = (intake.unreviewed_stream(stream, FIXTURE).writeStream.format("parquet")
         .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r[0] for r in spark.read.parquet(f"{d}/out").select("event_id").collect()}
    assert got == {1}


def test_a_redelivered_file_adds_no_flag(spark, adm01):
    """Delivered twice, in one batch and in a later one, after a restart; an
    admission entered years late is flagged, rows without an id all are."""
    from carepulse.config import DEFAULTS
    from carepulse.sources.schema import COLUMNS, with_admission_id
    d = tempfile.mkdtemp(prefix="carepulse-redeliver-", dir="/tmp")
    rows = with_admission_id(adm01.select(*COLUMNS)).dropDuplicates(["admission_id"]).select("admission_id", *COLUMNS)
    rows.limit(4000).coalesce(1).write.parquet(f"{d}/rows")
    rows = spark.read.parquet(f"{d}/rows")
    want = intake.risk_flags(rows, DEFAULTS).count()

    def deliver(df, times=1):
        for _ in range(times):
            df.write.mode("append").parquet(f"{d}/in")
        stream = intake.admissions_stream(spark, f"{d}/in", df.select("admission_id").schema)
        intake.start_risk_intake(stream, f"{d}/flags", f"{d}/chk", DEFAULTS, available_now=True).awaitTermination()
        return spark.read.parquet(f"{d}/flags").count()
    assert deliver(rows, 2) == want                     # twice in one batch
    assert deliver(rows) == want                        # and again, by a restarted query
    late = intake.risk_flags(rows, DEFAULTS).select("admission_id").limit(3)
    late = rows.join(late, "admission_id").withColumns({
        "admission_id": F.concat(F.lit("late-"), "admission_id"),
        "date_of_admission": F.lit("1980-01-01").cast("date")}).select("admission_id", *COLUMNS)
    assert deliver(late) == want + late.count()
    nameless = late.withColumn("admission_id", F.lit(None).cast("string"))
    assert deliver(nameless) == want + 2 * late.count()
