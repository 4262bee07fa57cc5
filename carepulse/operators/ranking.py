"""Global ranking without a single-task window.

``Window.orderBy(...)`` with no ``partitionBy`` sends every row to one task.
:func:`rank_many` computes RANK, DENSE_RANK, ROW_NUMBER, NTILE and PERCENT_RANK
over any number of global orders with one plan at every size:

* with several orders each row is copied once per order, tagged with the order's
  number and holding that order's sort values only; one range shuffle by (tag,
  sort values) sorts them all, so a row's place in its partition is known without
  a window (:func:`placed`);
* the row counts per partition and tag (one row each, so their broadcast is
  bounded) turn places into row numbers of each order;
* the copies of a row meet again by its key; NTILE is arithmetic on the row
  number and the row count;
* RANK and PERCENT_RANK of a value are its least row number, found per value
  with a map-side combined aggregate and joined back; DENSE_RANK counts those
  least rows, again per partition first.

The sorted rows are checkpointed, as range bounds come from a sample and two
evaluations may cut differently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS
from .joins import checkpointed, join_counted


@dataclass(frozen=True)
class Key:
    """One sort column: name, direction; NULLs follow Spark's default
    (first when ascending, last when descending) unless set."""
    name: str
    desc: bool = False
    nulls_first: bool | None = None

    def sort(self, c: Column | None = None) -> Column:
        c = F.col(self.name) if c is None else c
        nf = (not self.desc) if self.nulls_first is None else self.nulls_first
        if self.desc:
            return c.desc_nulls_first() if nf else c.desc_nulls_last()
        return c.asc_nulls_first() if nf else c.asc_nulls_last()


def _keys(spec) -> list[Key]:
    out = []
    for k in spec:
        if isinstance(k, Key):
            out.append(k)
        elif isinstance(k, str):
            out.append(Key(k))
        else:
            out.append(Key(*k))
    return out


def ntile_of(rn: Column, n: Column | int, k: int) -> Column:
    """NTILE(k) from a 1-based row number and the row count: the first
    ``n % k`` tiles hold ``n div k + 1`` rows, the others ``n div k``."""
    n = F.lit(n) if isinstance(n, int) else n
    q = F.floor(n / k).cast("long")
    rem = (n % k).cast("long")
    big = rem * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
            .otherwise(rem + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1) \
            .cast("long")


def _to_here(w=Window):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def placed(df: DataFrame, group: str, sort: list[Column]) -> DataFrame:
    """Add ``_rn``, the 1-based place of each row in the order ``sort`` of the
    rows with its ``group``, and ``_all``, their number.  ``sort`` must be unique
    per row of a group; the groups are few (orders, kinds of entity).  One range
    shuffle and one checkpoint, however many groups there are."""
    order = [F.col(group), *sort]
    r = (df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order)
           .withColumn("_m", F.monotonically_increasing_id()))
    r = checkpointed(r)
    r = r.withColumns({"_b": F.shiftright("_m", 33), "_p": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row per partition and group that meet: partitions + groups at most
    runs = r.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_p0"))
    w = Window.partitionBy(group)
    runs = runs.select(F.col(group).alias("_g"), F.col("_b").alias("_rb"), F.sum("_n").over(w).alias("_all"),
                       (F.sum("_n").over(_to_here(w.orderBy("_b"))) - F.col("_n") - F.col("_p0")).alias("_off"))
    return (r.join(F.broadcast(runs), (F.col("_b") == F.col("_rb")) & F.col(group).eqNullSafe(F.col("_g")))
             .withColumn("_rn", F.col("_off") + F.col("_p") + 1).drop("_m", "_p", "_off", "_g", "_rb"))


def rank_all(df: DataFrame, by, tie=(), *, rank: str | None = None,
             dense_rank: str | None = None, row_number: str | None = None,
             ntile: tuple[int, str] | list[tuple[int, str]] | None = None,
             percent_rank: str | None = None, cfg: Config = DEFAULTS) -> DataFrame:
    """Add global ranking columns.

    ``by``: the ORDER BY keys (RANK / DENSE_RANK / PERCENT_RANK tie on them);
    ``tie``: extra keys that make the order unique for ROW_NUMBER / NTILE
    (the reference leaves NTILE ties arbitrary; we make them deterministic).
    """
    spec = dict(by=by, tie=tie, rank=rank, dense_rank=dense_rank, row_number=row_number,
                ntile=ntile, percent_rank=percent_rank)
    return rank_many(df, [spec], cfg=cfg)


def rank_many(df: DataFrame, specs: list[dict], *, cfg: Config = DEFAULTS) -> DataFrame:
    """Apply several ranking specs over one input.

    Each spec is a dict with ``by``, optional ``tie``, output names (``rank``,
    ``dense_rank``, ``row_number``, ``ntile=(k, name)``, ``percent_rank``) and
    optional ``with_`` (columns computed from earlier specs' outputs first).
    Specs up to the next ``with_`` share one range shuffle; where there are
    several of them their ``tie`` must be the same and name a unique key.
    ``few`` marks a rank over a score with a bounded number of values."""
    batch: list[dict] = []
    for spec in [*specs, None]:
        if batch and (spec is None or spec.get("with_") or _only_ranked(spec) or _only_ranked(batch[0])):
            df = _rank_values(df, batch[0], cfg) if _only_ranked(batch[0]) else _rank_batch(df, batch)
            batch = []
        if spec is not None:
            if spec.get("with_"):
                df = df.withColumns(spec["with_"])
            batch.append(spec)
    return df


def _only_ranked(spec: dict) -> bool:
    """Only values are ordered, so they are counted first."""
    return not (spec.get("row_number") or spec.get("ntile") or spec.get("dense_rank"))


def _ntiles(spec) -> list[tuple[int, str]]:
    nt = spec.get("ntile")
    return [] if nt is None else ([nt] if isinstance(nt, tuple) else list(nt))


def _rank_batch(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Specs over one input by one range shuffle."""
    columns, orders = df.columns, [_keys(s["by"]) + _keys(s.get("tie") or ()) for s in specs]
    if len(specs) == 1:
        rows = placed(df.withColumn("_o", F.lit(0)), "_o", [k.sort() for k in orders[0]])
        out = rows.withColumnsRenamed({"_rn": "_rn0"})
    else:
        key = [k.name for k in _keys(specs[0]["tie"])]
        if any([k.name for k in _keys(s.get("tie") or ())] != key for s in specs):
            raise ValueError("specs that are ranked together need one and the same tie key")
        rest = [c for c in columns if c not in key]
        # a copy per order: its own sort values, the other columns on the first only
        copies = df.select("*", F.explode(F.array(*map(F.lit, range(len(specs))))).alias("_o"))
        sorts = {f"_s{i}_{j}": (i, k) for i, by in enumerate(orders) for j, k in enumerate(by) if k.name not in key}
        copies = copies.select(
            *key, "_o", *[F.when(F.col("_o") == i, F.col(k.name)).alias(c) for c, (i, k) in sorts.items()],
            *[F.when(F.col("_o") == 0, F.col(c)).alias(c) for c in rest])
        # rows of one order have NULL in the others' sort columns: no say in its order
        rows = placed(copies, "_o", [k.sort(F.col(c)) for c, (_, k) in sorts.items()]
                      + [k.sort() for k in orders[0] if k.name in key])
        out = rows.groupBy(*key).agg(
            F.max("_all").alias("_all"), *[F.max(F.when(F.col("_o") == 0, F.col(c))).alias(c) for c in rest],
            *[F.max(F.when(F.col("_o") == i, F.col("_rn"))).alias(f"_rn{i}") for i in range(len(specs))])
    cols: dict[str, Column] = {}
    for i, spec in enumerate(specs):
        for k, name in _ntiles(spec):
            cols[name] = ntile_of(F.col(f"_rn{i}"), F.col("_all"), k)
        if spec.get("row_number"):
            cols[spec["row_number"]] = F.col(f"_rn{i}").cast("long")
        if spec.get("rank") or spec.get("dense_rank") or spec.get("percent_rank"):
            names = [k.name for k in _keys(spec["by"])]
            one = rows.where(F.col("_o") == i)
            if len(specs) > 1:
                one = one.withColumns({k.name: F.col(c) for c, (n, k) in sorts.items() if n == i})
            ranks = _ranks_of(one, names, bool(spec.get("dense_rank")))
            out = join_on_keys(out, ranks.withColumnsRenamed({"_rank": f"_rank{i}", "_dense": f"_dense{i}"}), names)
            if spec.get("dense_rank"):
                cols[spec["dense_rank"]] = F.col(f"_dense{i}").cast("long")
            cols |= _rank_columns(spec, F.col(f"_rank{i}"))
    return out.select(*columns, *[c.alias(name) for name, c in cols.items()])


def _ranks_of(rows: DataFrame, names: list[str], dense: bool) -> DataFrame:
    """Per value its ``_rank``, the least row number, and ``_dense``, the number
    of values up to it.  Values are counted per partition of the sorted rows."""
    least = rows.groupBy(*names).agg(F.min(F.struct("_rn", "_b")).alias("_at"))
    least = least.select(*names, F.col("_at._rn").alias("_rank"), F.col("_at._b").alias("_b"))
    if not dense:
        return least.drop("_b")
    heads = least.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.select(F.col("_b").alias("_hb"), (F.sum("_n").over(_to_here(Window.orderBy("_b")))
                                                    - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_rank"))
    return least.withColumn("_place", place).join(F.broadcast(heads), F.col("_b") == F.col("_hb")) \
        .select(*names, "_rank", (F.col("_before") + F.col("_place")).alias("_dense"))


def _rank_columns(spec: dict, rank: Column) -> dict[str, Column]:
    """The outputs that follow from the rank and ``_all``."""
    cols = {}
    if spec.get("rank"):
        cols[spec["rank"]] = rank.cast("long")
    if spec.get("percent_rank"):
        cols[spec["percent_rank"]] = F.when(F.col("_all") <= 1, F.lit(0.0)).otherwise(
            (rank - 1) / F.greatest(F.col("_all") - 1, F.lit(1)))
    return cols


def _rank_values(df: DataFrame, spec: dict, cfg: Config) -> DataFrame:
    """RANK and PERCENT_RANK by the values' row counts."""
    by = _keys(spec["by"])
    names, columns = [k.name for k in by], df.columns
    if spec.get("few"):
        side = F.broadcast(_few_values(df, by))
    else:
        df = checkpointed(df)
        counts = checkpointed(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")))
        side = rows_before(counts, [k.sort() for k in by], "_c").withColumn("_rank", F.col("_before") + 1)
    if spec.get("percent_rank"):
        df = df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))
    out = join_on_keys(df, side.select(*names, "_rank"), names)
    return out.select(*columns, *[c.alias(name) for name, c in _rank_columns(spec, F.col("_rank")).items()])


def _few_values(df: DataFrame, by: list[Key]) -> DataFrame:
    """The values of a bounded score with ``_rank``: one row per value, so their
    window stays in one task."""
    counts = df.groupBy(*[k.name for k in by]).agg(F.count(F.lit(1)).alias("_c"))
    running = F.sum("_c").over(_to_here(Window.orderBy(*[k.sort() for k in by])))
    return counts.select(*[k.name for k in by], (running - F.col("_c") + 1).alias("_rank"))


def rows_before(counts: DataFrame, sort: list[Column], count: str) -> DataFrame:
    """Add ``_before``: the sum of ``count`` over the rows before, in the order
    ``sort`` (unique).  Rows are range-partitioned; running sums stay in a
    partition, and the partitions' totals (one row each) are broadcast."""
    r = checkpointed(counts.repartitionByRange(_partitions(counts), *sort)
                     .withColumn("_b", F.spark_partition_id()))
    totals = r.groupBy("_b").agg(F.sum(count).alias("_n"))
    before = totals.select(F.col("_b").alias("_rb"), (F.sum("_n").over(_to_here(Window.orderBy("_b")))
                                                      - F.col("_n")).alias("_off"))
    inside = F.sum(count).over(_to_here(Window.partitionBy("_b").orderBy(*sort))) - F.col(count)
    return (r.withColumn("_in", inside).join(F.broadcast(before), F.col("_b") == F.col("_rb"))
             .withColumn("_before", F.col("_off") + F.col("_in")).drop("_b", "_rb", "_off", "_in"))


def join_on_keys(df: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    """Join per-key results back to the rows (NULL-safe); Spark chooses the
    join by bytes and splits hot keys (AQE)."""
    ren = {n: f"_k{i}" for i, n in enumerate(names)}
    side = side.withColumnsRenamed(ren)
    cond = None
    for n, r in ren.items():
        c = F.col(n).eqNullSafe(F.col(r))
        cond = c if cond is None else cond & c
    return df.join(side, cond, "inner").drop(*ren.values())


def rank_by_counts(df: DataFrame, by, *, rank: str, cfg: Config = DEFAULTS) -> DataFrame:
    """RANK of rows over a key with few values (a bounded score): 1 + the rows
    with a strictly earlier key.  Counts per value are combined map-side, so a
    value with a third of all rows costs one row; the rows are neither ordered
    nor moved: the ranked values are counted and broadcast."""
    by_k = _keys(by)
    side = _few_values(df, by_k).withColumn(rank, F.col("_rank").cast("long")).drop("_rank")
    return join_counted(df, side, [k.name for k in by_k]).select(*df.columns, rank)


def top_k_per_group(df: DataFrame, group, order, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows whose RANK within ``group`` is at most ``k`` (ties kept).  Spark
    plans this with a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*[x.sort() for x in _keys(order)])
    return df.withColumn(rank_col, F.rank().over(w).cast("long")).filter(F.col(rank_col) <= k)
