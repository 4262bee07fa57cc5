"""Admission intake: the risk model on arriving rows (X1) and the review
deadline check (X2).

X1 applies the same ``risk_score`` Column as the batch analyses to a
``readStream`` source and appends the flagged rows to a sink.  A file that is
delivered again adds no flag: flagged admissions are remembered by id for a span
of arrival time (:func:`once_per_admission`).

X2 asks, for each flagged admission, whether a review happened within
``review_within_hours``.  On the driver tables it runs over ``events``
(``signup`` = admission, ``view`` = review, keyed by ``user_id``).

* Batch form (:func:`review_check`): signups and reviews are bucketed by user
  and a stretch of time as long as the window; a review is also copied into the
  bucket before, so every signup meets all reviews that can answer it.  A
  running minimum over each bucket, in reverse time order, gives the first
  review at or after each signup.  No pair of rows is ever emitted and a very
  active user is split by time, not held in one task.
* Streaming form (:func:`unreviewed_stream`): ``applyInPandasWithState`` keyed
  by the same (user, stretch) buckets keeps only the pending signups and the
  review times that can still answer one; when the watermark passes a signup's
  deadline with no review seen, the signup is emitted (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import Config, DEFAULTS
from ..functions import exprs as X
from ..session import SHUFFLES_GO, settings
from ..sources.schema import CODEC, SCHEMA

SIGNUP, VIEW = "signup", "view"
_PROVIDER, _KIND = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state."
#: Known ids lie on the executors' disks: in their heaps each takes some 240 bytes.
#: What a query that ended had there goes by the next maintenance.
STATE = {_PROVIDER: f"{_KIND}RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
         "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}


# ------------------------------------------------------------------ X1
def risk_flags(adm: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Rows at or above the review threshold, with their score and tier.
    Works unchanged on a batch or a streaming DataFrame."""
    r = X.with_risk(adm, cfg).filter(F.col("risk_score") >= cfg.review_threshold)
    keys = [k for k in cfg.row_keys if k in adm.columns]
    return r.select(*keys, "date_of_admission", "hospital", "doctor", "risk_score", "risk_tier")


def admissions_stream(spark: SparkSession, source_dir: str, extra_schema=None,
                      max_files_per_trigger: int | None = None,
                      max_bytes_per_trigger: int | None = None) -> DataFrame:
    """``readStream`` over a folder of admission Parquet files."""
    extra = [] if extra_schema is None else list(extra_schema.fields)
    schema = T.StructType(SCHEMA.fields + extra)      # a new one: SCHEMA is shared
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.load(source_dir)


def once_per_admission(flags: DataFrame, keys: list[str], redelivery: str = "7 days") -> DataFrame:
    """A stream's flags with each admission (its ``keys``) once, if it comes again
    within ``redelivery`` of its first arrival.  The watermark is on the arrival
    (the batch's time, which a restart repeats), not on the admission date: an
    admission entered weeks late is still flagged.  Flags without any key are all
    kept.  The state holds the keys of flagged admissions only, for that span; an
    admission that rises to the threshold when it is delivered again corrected is
    flagged then."""
    named = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    key = F.when(named, F.to_json(F.struct(*keys))).otherwise(F.uuid())
    arrived = flags.withColumns({"_arrived": F.current_timestamp(), "_key": key})
    return arrived.withWatermark("_arrived", redelivery).dropDuplicatesWithinWatermark(["_key"]) \
        .drop("_arrived", "_key")


def start_risk_intake(adm_stream: DataFrame, sink_dir: str, checkpoint_location: str,
                      cfg: Config = DEFAULTS, available_now: bool = False,
                      processing_time: str | None = "1 minute", redelivery: str | None = "7 days",
                      state_partitions: int | None = None):
    """Append flagged admissions to a Parquet sink (exactly-once via the
    checkpoint location, which must be on shared storage); with ``redelivery``,
    and where the rows carry their keys, each admission once.  The shuffle files of
    a batch go with it.  The ids are held as ``STATE`` says, unless the session names
    another store than Spark's usual one, or a checkpoint was begun with one, in
    ``state_partitions`` parts for the checkpoint's life (default: the session's
    shuffle partitions); each part allots some MB on its executor's disk."""
    flags = risk_flags(adm_stream, cfg)
    keys = [k for k in cfg.row_keys if k in flags.columns]
    if redelivery and keys:
        flags = once_per_admission(flags, keys, redelivery)
    w = (flags.writeStream.format("parquet")
         .option("compression", CODEC).option("path", sink_dir).option("checkpointLocation", checkpoint_location)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    spark, usual = flags.sparkSession, f"{_KIND}HDFSBackedStateStoreProvider"
    held = STATE if spark.conf.get(_PROVIDER, usual) == usual else {}
    if state_partitions:
        held = held | {"spark.sql.shuffle.partitions": str(state_partitions)}
    with settings(spark, SHUFFLES_GO | held):        # the query keeps those it starts with
        return w.start()


# ------------------------------------------------------------------ X2 batch
def review_check(events: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Every signup with whether a view of the same user followed within the
    window, and the minutes to the first such view."""
    hours = cfg.review_within_hours
    e = events.where(F.col("event_type").isin(SIGNUP, VIEW)).select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == VIEW).cast("int").alias("kind"))
    width = max(1, hours * 3_600_000_000)
    at = F.unix_micros("ts")
    start = at - F.pmod(at, F.lit(width))
    # a view answers signups of its own and of the previous stretch only (one
    # scan, two copies of a view); a view without a user answers nobody
    e = e.where("kind = 0 or user_id is not null")
    u = e.withColumn("bucket", F.explode(
        F.when(F.col("kind") == 1, F.array(start, start - width)).otherwise(F.array(start))))
    w = (Window.partitionBy("user_id", "bucket")
         .orderBy(F.col("ts").desc(), F.col("kind").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_next", F.min(F.when(F.col("kind") == 1, F.col("ts"))).over(w))
    due = F.col("ts") + F.make_interval(hours=F.lit(hours))
    # an undated signup cannot be answered: reviewed is false, never NULL
    ok = F.coalesce(F.col("_next").isNotNull() & (F.col("_next") <= due), F.lit(False))
    minutes = (F.unix_micros("_next") - F.unix_micros("ts")) / 60_000_000.0
    return u.where("kind = 0").select(
        "event_id", "user_id", ok.alias("reviewed"),
        X.rhu(F.when(ok, minutes), 2).alias("minutes_to_review"))


def x2_review_deadline_check(events: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    return review_check(events, cfg)


# ------------------------------------------------------------------ X2 stream
OUT_SCHEMA = "event_id long, user_id long, ts timestamp, deadline timestamp"
STATE_SCHEMA = "pending_ids array<long>, pending_ts array<long>, views array<long>"


def _pending_update(hours: int):
    width = max(1, hours * 3_600_000_000)

    def fn(key, pdfs, state):
        import numpy as np
        import pandas as pd

        user, start = int(key[0]), int(key[1])
        kept = state.get if state.exists else ([], [], [])
        ids, ts, views = (np.array(x or [], np.int64) for x in kept)
        wm = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            new = pd.concat(list(pdfs))
            at, is_view = new["us"].to_numpy(np.int64), new["is_view"].to_numpy(bool)
            views = np.concatenate((views, at[is_view]))
            ids = np.concatenate((ids, new["event_id"].to_numpy(np.int64)[~is_view]))
            ts = np.concatenate((ts, at[~is_view]))
        # a signup is answered by the first view at or after it, if in time
        views = np.unique(views)
        first = np.append(views, np.iinfo(np.int64).max)[np.searchsorted(views, ts)]
        waiting = first > ts + hours * 3_600_000_000
        ids, ts = ids[waiting], ts[waiting]
        due = ts + hours * 3_600_000_000 < wm
        out = ids[due], ts[due]
        ids, ts = ids[~due], ts[~due]
        # later signups of this stretch are not before the watermark
        views = views[views >= wm] if not len(ts) else views[views >= min(wm, ts.min())]
        now = state.getCurrentWatermarkMs()
        if len(ids):
            state.update((ids.tolist(), ts.tolist(), views.tolist()))
            state.setTimeoutTimestamp(max(int(ts.min() + hours * 3_600_000_000) // 1000 + 1, now + 1))
        elif len(views) and wm < start + width:
            state.update(([], [], views.tolist()))
            state.setTimeoutTimestamp(max((start + width) // 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        if len(out[0]):
            yield pd.DataFrame({
                "event_id": out[0], "user_id": user,
                "ts": pd.to_datetime(out[1], unit="us", utc=True),
                "deadline": pd.to_datetime(out[1] + hours * 3_600_000_000, unit="us", utc=True)})

    return fn


def unreviewed_stream(events_stream: DataFrame, cfg: Config = DEFAULTS,
                      lateness: str = "1 hour") -> DataFrame:
    """Signups with no view of the same user within the window, emitted once
    the watermark has passed their deadline.  State is kept per user and stretch
    of the window's length, so one user's events are not one task's."""
    width = max(1, cfg.review_within_hours * 3_600_000_000)
    # rows without a user or a time cannot be placed in event time
    e = (events_stream.where(F.col("event_type").isin(SIGNUP, VIEW)
                             & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
         .select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                 (F.col("event_type") == VIEW).alias("is_view"))
         .withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts")))
    start = F.col("us") - F.pmod("us", F.lit(width))
    e = e.withColumn("bucket", F.explode(
        F.when(F.col("is_view"), F.array(start, start - width)).otherwise(F.array(start))))
    return e.groupBy("user_id", "bucket").applyInPandasWithState(
        _pending_update(cfg.review_within_hours), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
