"""Registry of every analysis key and how to load the admissions input."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, FIXTURE
from ..session import SHUFFLES_GO, ensure_checkpoint_dir, settings
from ..sources.fixture import fixture_admissions, fixture_columns, fixture_rows, table
from ..streaming import intake
from ..sources.schema import with_derived
from . import advanced, behaviour, dashboard, explore, operations, revenue

_MODULES = (explore, revenue, behaviour, operations, advanced, dashboard)

ANALYSES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {}
for _m in _MODULES:
    for _name in sorted(dir(_m)):
        if _name[:1] in "erboadm" and _name[1:3].isdigit() and _name[3] == "_":
            ANALYSES[_name] = getattr(_m, _name)


# analyses over the events table (the intake extension's batch twin)
EVENT_ANALYSES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "x2_review_deadline_check": intake.x2_review_deadline_check,
}
ALL = {**ANALYSES, **EVENT_ANALYSES}


def _lifecycle() -> dict[str, Callable[[DataFrame, Config], DataFrame]]:
    from .lifecycle import LIFECYCLE as found      # it uses the marts, which use the analyses here
    return found


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture admissions view (lazy; the joins run inside each query)."""
    return with_derived(fixture_admissions(spark, sf_dir))


def materialized_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the fixture view once as Parquet, partitioned by admission year,
    into the session's checkpoint folder (shared storage on a cluster) and
    read it back: the flat table the reference imports once and then queries.
    Built once per session and sf folder."""
    with _BUILD_LOCK:
        return _materialized(spark, sf_dir)


_BUILD_LOCK = threading.Lock()


_BUILT: set[str] = set()


def _materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not base:          # no shared folder known: run on the lazy view instead
        return admissions(spark, sf_dir)
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    path = f"{base}/admissions-{tag}"
    # the checkpoint folder is unique to this SparkContext, so a path recorded
    # here was completely written by this process
    if path not in _BUILT:
        from ..sources.schema import CODEC, passes, write_admissions
        # the joins run once: the range sort reads its input twice; rows are
        # staged and sorted in their short form, many of them in parts, so that
        # the disks hold the shuffle files of one part only
        n = passes(table(spark, sf_dir, "lineitem").count())
        with settings(spark, SHUFFLES_GO):
            for i in range(n):
                fixture_rows(spark, sf_dir, (i, n)).write.mode("append" if i else "overwrite") \
                    .option("compression", CODEC).parquet(f"{path}-staged")
        write_admissions(spark.read.parquet(f"{path}-staged"), path, finish=fixture_columns)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-staged")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _BUILT.add(path)
    return with_derived(spark.read.parquet(path))


def run(name: str, spark: SparkSession, sf_dir: str, cfg: Config = FIXTURE,
        adm: DataFrame | None = None, materialize: bool = False) -> DataFrame:
    """Run one analysis over the fixture at ``sf_dir``.  With ``materialize``
    the flat admissions table is built once per session (see
    :func:`materialized_admissions`) and every analysis reads it."""
    if name in _lifecycle():
        return _lifecycle()[name](materialized_admissions(spark, sf_dir) if adm is None else adm, cfg)
    if name in EVENT_ANALYSES:
        return EVENT_ANALYSES[name](table(spark, sf_dir, "events"), cfg)
    if adm is None:
        adm = (materialized_admissions(spark, sf_dir) if materialize
               else admissions(spark, sf_dir))
    return ANALYSES[name](adm, cfg)
