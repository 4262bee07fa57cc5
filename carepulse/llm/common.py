"""Shared helpers: reading tables, Arrow batches per task, checkpoints, broadcasts.

Conventions of every operator here:

* it selects the columns it needs by name first, or, where it returns all of
  them, gives the others names of its own meanwhile (:func:`parked`), so extra
  input columns never clash; output columns are the ones its docstring lists;
* a null text counts as an empty text, an empty table gives an empty result;
* text is taken from Arrow as bytes and decoded with replacement, so a broken
  byte sequence cannot fail a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of an Arrow batch handled at a time: bounds the Python objects alive.
SLICE_ROWS = 256
#: Upper bound of a broadcast table in bytes; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable],
                rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with ``start()`` called once per task: it returns the
    function from a small record batch to a record batch (or None)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for b in batches:
            for i in range(0, b.num_rows, rows):
                out = step(b.slice(i, rows))
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def as_texts(col: pa.Array) -> list[str]:
    """Texts of a string column; null gives ''."""
    return [x.decode("utf-8", "replace") for x in as_bytes(col)]


def batch(*cols: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names=names)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder ``spark.checkpoint.dir``
    (removed by Spark's cleaner when no longer referenced)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table below the shared checkpoint folder, and the
    function that removes it once nothing reads it any more (at the latest the
    end of the JVM does)."""
    spark = df.sparkSession
    jvm, path = spark._jvm, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: fs.delete(where, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a table whose counted size is within the bound; the
    plain table, joined by shuffle, otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def parked(df: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that are not ``used`` under names that no operator
    uses, and the renaming that gives theirs back."""
    names = {c: f"_parked_{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def held_out(id_col: Column, parts: int, rest: int = 2) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``rest`` (null id: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == rest, F.lit(False))
