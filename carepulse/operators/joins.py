"""Joining the fact with a small aggregate without moving the fact.

Left to the size estimates, Spark plans a sort-merge join for an aggregate it
cannot size and hashes the whole fact by the join key, often a category with a
handful of values.  Here the aggregate is computed first and measured; below a
byte bound it is broadcast, above it both sides are salted, so that a key with a
third of all rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Greatest measured size of a broadcast side, in bytes.
BROADCAST_BYTES = 8 << 20
#: Tasks that one key is dealt to where the side is not broadcast.
SALTS = 32


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: 16 bytes a column and its texts' bytes."""
    total = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    return total


def join_counted(fact: DataFrame, side: DataFrame, on: list[str], how: str = "inner",
                 bound: int = BROADCAST_BYTES) -> DataFrame:
    """``fact`` joined to the checkpointed and measured ``side`` on equal, NULL-safe
    keys (one row per key); ``how`` is inner, left or left_semi.  The fact's
    columns come first, then the side's others."""
    side = checkpointed(side)
    size = side.agg(F.sum(row_bytes(side))).first()[0] or 0
    renamed = {c: f"_j{i}" for i, c in enumerate(on)}
    side = side.withColumnsRenamed(renamed)
    cond = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
    if size <= bound:
        return fact.join(F.broadcast(side), cond, how).drop(*renamed.values())
    fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int"))
    side = side.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return fact.join(side, [*cond, F.col("_salt") == F.col("_slot")], how).drop("_salt", "_slot", *renamed.values())
