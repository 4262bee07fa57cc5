"""Whitening of embedding vectors by their principal components.

1. One pass counts the rows and adds the integer vectors x per dimension, in
   each task with exact integers; Spark adds the tasks' sums.
2. A second pass adds the products of the vectors less the rounded mean
   (centred before multiplying; whole numbers, so the sums are exact as long
   as they stay below 2**53), again per task and then in Spark.  What reaches
   the driver is dimensions squared numbers, whatever the number of rows.
3. The eigenpairs of that matrix come from contour integration with inertia
   counts (:mod:`.feast`); only the wanted ones are computed.
4. A third pass measures the covariance of the whitened rows against the
   identity, and the result is one more scan that multiplies each batch.

No pass shuffles a row, and a lost task is simply run again.  The passes before
the result run when the function is called, as the eigenvectors need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feast
from .common import batch, map_batches, table

#: Greatest number of dimensions: their square is what the driver and each task hold.
MAX_DIMENSIONS = 2048
#: Entries times the scale beyond this are not whole-number exact in a double.
MAX_ENTRY = 2.0 ** 52
#: Eigenvalues below this share of the greatest possible one count as zero.
RANK_TOLERANCE = 1e-11
#: Rows of a batch in the passes, and of a batch that is written.
ROWS, OUT_ROWS = 4096, 1024


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]            # of x per dimension
    centre: tuple[int, ...]          # the rounded mean
    rest: np.ndarray                 # mean less the rounded mean
    basis: np.ndarray                # dimensions x components, unit columns
    values: np.ndarray               # eigenvalues, falling
    trace: float


def usable(column: str, scale: float):
    """Condition: a vector with entries, each of them finite and small enough."""
    v = F.col(column)
    return (F.size(v) > 0) & F.coalesce(F.forall(
        v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < MAX_ENTRY, F.lit(False))
        & ~F.isnan(c.cast("double"))), F.lit(False))


def dimensions_of(vectors: DataFrame, column: str, scale: float) -> int | None:
    """The most frequent length of the usable vectors (of two the greater)."""
    top = vectors.where(usable(column, scale)).groupBy(F.size(column).alias("d")).count() \
        .orderBy(F.desc("count"), F.desc("d")).first()
    if top and top["d"] > MAX_DIMENSIONS:
        raise ValueError(f"{top['d']} dimensions; at most {MAX_DIMENSIONS} can be whitened")
    return top["d"] if top else None


def whole(col: pa.Array, d: int, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable rows of a list column and their x, as integers."""
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(all="ignore"):
        flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale
        good = np.abs(flat) < MAX_ENTRY                     # null and NaN are not
    ok = lengths == d
    row = np.repeat(np.arange(len(lengths)), lengths)
    ok[row[~good]] = False
    x = np.floor(flat[ok[row]]).astype(np.int64) + offset
    return np.flatnonzero(ok), x.reshape(-1, d)


def per_task(df: DataFrame, schema: str, start: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """``mapInArrow`` with ``start()`` once per task: it returns the function
    that takes a small batch in and the one that gives the task's only batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, result = start()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                add(b.slice(i, ROWS))
        yield result()
    return df.mapInArrow(run, schema)


def column_sums(vectors: DataFrame, column: str, d: int, scale: float, offset: int) -> tuple[int, list[int]]:
    """The number of usable rows and their sums per dimension, exact."""
    def start():
        total, n = [0] * d, 0

        def add(b: pa.RecordBatch) -> None:
            nonlocal n
            _, x = whole(b.column(0), d, scale, offset)
            if len(x):
                exact = np.abs(x).max() < 2 ** 62 // len(x)
                n += len(x)
                total[:] = map(int.__add__, total, (x if exact else x.astype(object)).sum(axis=0).tolist())

        def result() -> pa.RecordBatch:
            return batch(pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                         pa.array(total, pa.decimal128(38, 0)), names=["i", "n", "s"])
        return add, result
    parts = per_task(vectors.select(column), "i int, n bigint, s decimal(38,0)", start)
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [0] * d)


def products(vectors: DataFrame, column: str, d: int, size: int, scale: float, offset: int,
             row_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the usable rows of the outer product of ``row_of(x)`` with
    itself, as a symmetric matrix of ``size``."""
    i, j = np.triu_indices(size)

    def start():
        total = np.zeros((size, size))

        def add(b: pa.RecordBatch) -> None:
            _, x = whole(b.column(0), d, scale, offset)
            y = row_of(x)
            total[:] += y.T @ y

        def result() -> pa.RecordBatch:
            return batch(pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]),
                         names=["i", "j", "v"])
        return add, result
    parts = per_task(vectors.select(column), "i int, j int, v double", start)
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[rows["i"], rows["j"]] = rows["v"]
    return out + np.triu(out, 1).T


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 32,
                  scale: float = 64, offset: int = 1_000_000) -> Whitening | None:
    """The components of all usable vectors of ``vectors``; None if there are
    none.  x is floor(scale * entry) + offset.  Not usable: a null or empty
    vector, one with a null, non-finite or (times the scale) above
    :data:`MAX_ENTRY` entry, and one that has not the most frequent length.  With
    fewer directions than ``components`` in the data (one row, equal rows,
    constant dimensions) there are so many fewer components."""
    d = dimensions_of(vectors, column, scale)
    if d is None:
        return None
    n, sums = column_sums(vectors, column, d, scale, offset)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    mid = np.array(centre, dtype=np.int64)
    total = products(vectors, column, d, d, scale, offset, lambda x: (x - mid).astype(np.float64))
    cov = total / n - np.outer(rest, rest)
    values, basis = feast.greatest(cov, components, RANK_TOLERANCE)
    return Whitening(n, tuple(sums), tuple(centre), rest, basis, values, float(np.trace(cov)))


def _project(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    mid, rest, over = np.array(model.centre, np.int64), model.rest, model.basis / np.sqrt(model.values)
    return lambda x: ((x - mid).astype(np.float64) - rest) @ over


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", scale: float = 64,
                   offset: int = 1_000_000) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    cov = products(vectors, column, len(model.sums), k, scale, offset, _project(model)) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the sum of (n x - S)^2, exact; None where it exceeds a long."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if n * top < 2 ** 62 and np.abs(sums).max(initial=0) < 2 ** 62:
        y = x * n - sums.astype(np.int64)
        if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2 ** 63:
            return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - sums
    return [v if v < 2 ** 63 else None for v in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32,
           scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per usable vector and component (from 1, falling eigenvalue):
    ``key``, ``component``, ``n``, ``deviation`` (sum over the dimensions of
    (n x - S)^2; null if it exceeds a long), ``whitened``, ``explained`` and
    ``identity_error``.

    See :func:`fit_whitening` for the vectors that are not usable and for fewer
    components.  Keys are carried as they are; repeated rows count as often as
    they occur; an empty table gives an empty result."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    model = fit_whitening(vectors, column, components, scale, offset)
    k = len(model.values) if model else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, column, scale, offset)
    sums, project, d = np.array(model.sums, dtype=object), _project(model), len(model.sums)
    explained = model.values / model.trace

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            at, x = whole(b.column(1), d, scale, offset)
            rows = len(at)
            return batch(
                b.column(0).take(pa.array(np.repeat(at, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                pa.array(deviations(x, model.n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
        return step
    return map_batches(vectors.select(key, column), schema, start, rows=OUT_ROWS)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
