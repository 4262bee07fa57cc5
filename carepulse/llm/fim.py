"""Fill-in-middle by block rotation inside one byte buffer.

A text is cut twice at code points into prefix, middle and suffix.  Its bytes
are scanned for the cuts, the sentinels are inserted in place::

    <P> prefix <M> middle <S> suffix

and two neighbouring blocks change places by three reversals (reverse each,
then both together, which leaves every block's bytes in order):

* ``psm``: ``<M> middle`` with ``<S> suffix``: ``<P>prefix<S>suffix<M>middle``;
* ``spm``: everything before ``<S> suffix`` with it: ``<S>suffix<P>prefix<M>middle``.

:func:`restore` finds the sentinels in the output, rotates back and removes
them.  A sentinel cannot be mistaken: texts that hold one stay ``plain``, and
no sentinel overlaps another.

The cuts and the form of a row depend on its id alone, so a task that runs
again gives the same rows, and no row needs another one: there is no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batch, map_batches, table

# fixed values: the sentinels of the contract
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def numbers(key: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def reverse(buf: bytearray, a: int, b: int) -> None:
    buf[a:b] = buf[a:b][::-1]


def rotate(buf: bytearray, a: int, mid: int, b: int) -> None:
    """Exchange the neighbouring blocks [a, mid) and [mid, b) in place."""
    reverse(buf, a, mid)
    reverse(buf, mid, b)
    reverse(buf, a, b)


def arrange(text: bytes, first: int, second: int, spm: bool) -> bytearray:
    """The transformed text; ``first`` <= ``second`` are byte offsets."""
    buf = bytearray(text)
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + second
    rotate(buf, 0 if spm else middle, suffix, len(buf))
    return buf


def rebuild(output: bytes, form: str | None) -> bytes:
    """The text that :func:`arrange` made ``output`` from."""
    if form not in ("psm", "spm"):
        return output
    buf = bytearray(output)
    if form == "psm":          # <P>prefix | <S>suffix | <M>middle
        a, mid = buf.index(SUFFIX), buf.index(MIDDLE)
    else:                      # | <S>suffix | <P>prefix<M>middle
        a, mid = 0, buf.index(PREFIX)
    rotate(buf, a, mid, len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buf.index(mark)
        del buf[at:at + len(mark)]
    return bytes(buf)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1,
                   percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: ``key``, ``n`` (code points), ``form`` (plain, psm
    or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``percent`` of the rows are transformed, ``spm_percent`` of these as spm.  A
    null text is empty; an empty text, and one that holds a sentinel, is plain.
    A null key counts as an empty one.  Repeated rows give equal rows, an empty
    table none.  Bytes that are no UTF-8 stay as they are; a byte that continues
    no character is counted with the one before it."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
              "output binary")

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n, form, prefix, middle, output = [], [], [], [], []
            for k, t in zip(b.column(1).to_pylist(), as_bytes(b.column(2))):
                at = np.flatnonzero((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)
                h1, h2, h3, h4 = numbers(k, seed)
                n.append(len(at))
                if not t or h3 % 100 >= percent or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(t)
                    continue
                x, y = sorted((h1 % (len(at) + 1), h2 % (len(at) + 1)))
                spm = h4 % 100 < spm_percent
                first, second = (0 if c == 0 else len(t) if c == len(at) else int(at[c]) for c in (x, y))
                form.append("spm" if spm else "psm")
                prefix.append(x)
                middle.append(y - x)
                output.append(bytes(arrange(t, first, second, spm)))
            long = pa.int64()
            return batch(b.column(0), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long),
                         pa.array(middle, long), pa.array(output, pa.binary()),
                         names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])
        return step
    rows = docs.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
                       F.col(text).alias("t"))
    return map_batches(rows, schema, start).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """``made`` with ``out``, the text rebuilt from output and form alone (a
    null output or a form that is not psm or spm: the output itself; null gives
    an empty text).  Refuses a frame that already has a column ``out``."""
    if out in made.columns:
        raise ValueError(f"column {out} is there already")
    schema = T.StructType([*made.schema.fields, T.StructField(out, T.BinaryType())])
    at, kind = made.columns.index(output), made.columns.index(form)

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [rebuild(t, f) for t, f in zip(as_bytes(b.column(at)), b.column(kind).to_pylist())]
            return batch(*b.columns, pa.array(texts, pa.binary()), names=[*b.schema.names, out])
        return step
    return map_batches(made, schema, start).withColumn(out, F.col(out).cast("string"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS p4 FROM d),
f AS (
  SELECT *, least(c1, c2) AS x, greatest(c1, c2) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90
              THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (
  SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM f)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""
