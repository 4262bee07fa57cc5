"""Host-level quality rules.

Every document is measured once; rule failures are summed by host, each host's
failure rate is shrunk with a beta prior fitted to all hosts by moments, and the
host verdicts are joined back.  They decide on each document that holds the base:

* of a sound host (shrunk rate at most ``sound_limit``) it stays;
* of a flagged host (above ``host_limit``) it goes, unless its appeal succeeds:
  no rule fails with all limits halved, and lines do not repeat;
* of any other host it stays unless it fails a rule itself.

The fewer documents a host has, the nearer its shrunk rate is to the mean.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from .common import as_bytes, batch, checkpointed, map_batches, parked, table

WINDOW = 8
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
           "n_adjacent")
_OTHER_BYTES = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    min_words: int = 20             # base: fewer words fail
    repeat_pct: int = 30            # base: words in repeated 8-word windows
    symbol_pct: int = 10            # symbols per 100 words
    adjacent_pct: int = 20          # words equal to the word before
    dup_line_pct: int = 30          # repeated lines; by itself only on flagged hosts
    host_limit: float = 0.5         # shrunk failure rate above which a host is flagged
    sound_limit: float = 0.05       # shrunk failure rate up to which a host is sound
    max_strength: float = 1e6       # of the prior, when hosts do not differ


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more.  Windows are named by
    doubling: equal names of two halves name equal wholes, so it is exact."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # cheap test first: without equal sums of products there is no equal window
    mix = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD1342543DE82EF95) + mix[k:k + n]
    key.sort()
    if not (key[1:] == key[:-1]).any():
        return 0
    names, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while width < window:
        pair = names[:-width] * (int(names.max()) + 1) + names[width:]
        names, width = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * width
    twice = np.bincount(names)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """METRICS of one text (UTF-8)."""
    words = text.split()          # the ASCII blanks 0x20, 0x09-0x0D
    n = len(words)
    if not n:
        return 0, 0, len(text.translate(None, _OTHER_BYTES)), 0, 0, 0, 0
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    names: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
    return (n, chars, len(text.translate(None, _OTHER_BYTES)), len(lines),
            len(lines) - len(set(lines)), repeated_words(ids),
            int((ids[1:] == ids[:-1]).sum()))


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` plus METRICS (long) of each row's whole text (null: no words)."""
    kept = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema][:-1]
                       + [f"__{m} bigint" for m in METRICS])
    names = [*keys, *(f"__{m}" for m in METRICS)]

    def start():
        def step(b: pa.RecordBatch):
            got = np.array([measure_text(t) for t in as_bytes(b.column(b.num_columns - 1))],
                           np.int64).reshape(-1, len(METRICS))
            return batch(*(b.column(i) for i in range(len(keys))),
                         *(pa.array(got[:, i]) for i in range(len(METRICS))), names=names)
        return step
    return map_batches(kept, schema, start)


def _m(name: str) -> Column:
    return F.col(f"__{name}")


def base_failed(r: Rules) -> Column:
    return (_m("n_words") < r.min_words) | (
        100 * _m("n_repeat_words") > r.repeat_pct * _m("n_words"))


def failed(r: Rules) -> Column:
    """A document's own failure, whatever its host."""
    return (base_failed(r) | (100 * _m("n_symbols") > r.symbol_pct * _m("n_words"))
            | (100 * _m("n_adjacent") > r.adjacent_pct * _m("n_words")))


def failed_strictly(r: Rules) -> Column:
    """Failure under the limits of a flagged host."""
    return (failed(r) | (200 * _m("n_repeat_words") > r.repeat_pct * _m("n_words"))
            | (200 * _m("n_symbols") > r.symbol_pct * _m("n_words"))
            | (200 * _m("n_adjacent") > r.adjacent_pct * _m("n_words"))
            | (100 * _m("n_dup_lines") > r.dup_line_pct * _m("n_lines")))


def any_failure(r: Rules) -> Column:
    return failed(r) | (100 * _m("n_dup_lines") > r.dup_line_pct * _m("n_lines"))


def host_verdicts(measured: DataFrame, host: str, rules: Rules) -> DataFrame:
    """One row per host (null is a host): ``host, n, failures, shrunk, flagged, sound``.

    The prior is beta(m s, (1 - m) s): m the overall rate, s = 1/rho - 1 with rho
    the moment estimate of the correlation within hosts.  Counts are summed
    before any shuffle, so a host with a third of all rows costs no more."""
    hosts = measured.groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(any_failure(rules).cast("bigint")).alias("failures"))
    hosts = checkpointed(hosts)
    total = hosts.agg(
        F.sum("n").alias("N"), (F.sum("failures") / F.sum("n")).alias("m"),
        F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("f2"),
        F.sum("failures").alias("f"))
    # sum n (p - m)^2 = sum f^2/n - m f
    v = F.col("m") * (1 - F.col("m"))
    extra = F.col("N") - F.col("n2") / F.col("N") - (F.col("k") - 1)
    rho = F.try_divide(F.col("f2") - F.col("m") * F.col("f") - (F.col("k") - 1) * v, extra * v)
    prior = total.select("m", F.least(F.lit(rules.max_strength), F.greatest(
        F.lit(0.0), F.when(rho > 0, 1 / rho - 1).otherwise(rules.max_strength))).alias("s"))
    return hosts.crossJoin(F.broadcast(prior)).select(       # one row
        "__host", "n", "failures",
        ((F.col("failures") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))).alias("shrunk")
    ).withColumn("flagged", F.col("shrunk") > rules.host_limit) \
        .withColumn("sound", F.col("shrunk") <= rules.sound_limit)


def judged(measured: DataFrame, host: str, rules: Rules, verdicts: DataFrame) -> DataFrame:
    """``measured`` with ``__flagged``, ``__sound`` and ``__kept``.  Only hosts that
    are flagged or sound are joined: broadcast within a measured size, above it
    with salted hosts."""
    marked = verdicts.where("flagged OR sound").select(
        F.col("__host").alias(host), F.col("flagged").alias("__flagged"), F.col("sound").alias("__sound"))
    out = join_counted(measured, marked, [host], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("__flagged", "__sound")})
    return out.withColumn("__kept", ~F.when(F.col("__flagged"), failed_strictly(rules))
                          .when(F.col("__sound"), base_failed(rules)).otherwise(failed(rules)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: id, METRICS, ``base_failed``, ``host_flagged``,
    ``host_sound`` and ``kept``.  Repeated rows are measured alike and all returned."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(host).alias("__src"),
                       F.col(text).alias("text"))
    m = checkpointed(measure(rows, ["__id", "__src"]))
    out = judged(m, "__src", rules, host_verdicts(m, "__src", rules))
    return out.select(F.col("__id").alias(id_col), *(_m(x).alias(x) for x in METRICS),
                      base_failed(rules).alias("base_failed"),
                      F.col("__flagged").alias("host_flagged"), F.col("__sound").alias("host_sound"),
                      F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source",
              rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.  Texts are
    measured twice instead of being shuffled or stored."""
    narrow = docs.select(F.col(host).alias("__src"), F.col(text).alias("text"))
    verdicts = host_verdicts(measure(narrow, ["__src"]), "__src", rules)
    wide, back = parked(docs, [text])
    source = {v: k for k, v in back.items()}.get(host, host)
    m = measure_beside(wide.withColumn("__src", F.col(source)), text)
    return judged(m, "__src", rules, verdicts).where("__kept").select(*wide.columns) \
        .withColumnsRenamed(back)


def measure_beside(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with METRICS added, text kept."""
    return measure(docs, docs.columns, text)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "n_adjacent", "n_lines",
                      "host_flagged", "host_sound")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER o AS p,
        CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o
          || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o
          || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o END AS k
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1 AS twice, w = p AS adjacent, w FROM g),
c AS (SELECT *, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM t),
wm AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words,
              count(*) FILTER (WHERE adjacent) AS n_adjacent FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lm AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent
      FROM d LEFT JOIN wm USING (r) LEFT JOIN lm USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f2 AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_adjacent > 20 * n_words AS failed,
              100 * n_dup_lines > 30 * n_lines AS dup FROM f),
h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (WHERE failed OR dup) AS f FROM f2 GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(f * f / n) AS ff, sum(f) AS f FROM h),
q AS (SELECT m, CASE WHEN nn - n2 / nn - (k - 1) = 0 OR m * (1 - m) = 0 THEN NULL
             ELSE (ff - m * f - (k - 1) * m * (1 - m)) / ((nn - n2 / nn - (k - 1)) * m * (1 - m)) END AS rho FROM p),
s AS (SELECT m, least(1e6, greatest(0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1e6 END)) AS s FROM q),
v0 AS (SELECT host, (h.f + s.m * s.s) / (h.n + s.s) AS shrunk FROM h, s),
v AS (SELECT host, shrunk > 0.5 AS flagged, shrunk <= 0.05 AS sound FROM v0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT CASE WHEN flagged THEN failed OR dup OR 200 * n_repeat_words > 30 * n_words OR 200 * n_symbols > 10 * n_words
                          OR 200 * n_adjacent > 20 * n_words
           WHEN sound THEN base_failed ELSE failed END AS kept,
  n_adjacent, n_lines, flagged AS host_flagged, sound AS host_sound
FROM f2 JOIN v ON f2.source IS NOT DISTINCT FROM v.host
"""
