"""URL rules by expression lookup, with Spark expressions only.

A rule is a host and a path with a verdict; it fits its host and every
subdomain where the URL's path starts with the rule's path.

1. Each URL gives the expressions that a rule could be written as: the host's
   suffixes at label borders times the path's prefixes at slashes (and at the
   lengths of the rules that end inside a segment).  What is longer than any
   rule is cut off first, so a long URL costs no more than the rules are long,
   and URLs that cannot be told apart by the rules become one row (pre-aggregated
   in the map tasks: a hot host is a handful of rows).
2. Expressions meet the rules in an equi-join on the first :data:`SHORT` hex
   digits of their SHA-256; the whole digest confirms a hit.
3. Of the confirmed rules the longest wins, then the one with the longer host;
   of two verdicts for one rule, block.
4. The decided heads are joined back to the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small, table

#: Hex digits of the digest that rules and expressions are joined on.
SHORT = 8
#: Copies of the smaller side where a join is too large for a broadcast, so that
#: one hot key is dealt to so many tasks.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(_raw_host(url), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    tail = F.substring(rest, F.length(_raw_host(url)) + 1, F.lit(2**31 - 1))
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))


def _raw_host(url: Column) -> Column:
    rest = _rest(url)
    for mark in "/?#":
        rest = F.substring_index(rest, mark, 1)
    return rest


def prepared(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict) as one row per expression: ``short``,
    ``digest``, ``rule``, ``host_len``, ``path_len``, ``verdict``.  Hosts are
    put in lower case; a null path is empty; rules without a host or with a
    verdict other than allow or block are no rules."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"),
                     F.col("verdict").alias("v")).where("h <> '' and v in ('allow', 'block')")
    rule = F.concat("h", "p")
    digest = F.sha2(rule, 256)
    return r.groupBy("h", "p").agg(F.max("v").alias("verdict")).select(
        F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"), rule.alias("rule"),
        F.length("h").alias("host_len"), F.length("p").alias("path_len"), "verdict")


def expressions(tail: Column, head: Column, cuts: list[int]) -> Column:
    """What follows each dot of ``tail`` times all path prefixes of ``head``, as
    an array of texts."""
    def last_labels(n: Column) -> Column:
        return F.call_function("substring_index", tail, F.lit("."), -n)

    dots = F.size(F.split(tail, r"\.")) - 1
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(dots, F.lit(1))), last_labels)
    hosts = F.when(dots > 0, hosts).otherwise(F.array().cast("array<string>"))
    slashes = F.size(F.split(head, "/")) - 1
    paths = F.concat(F.array(F.lit("")), F.when(slashes > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(slashes, F.lit(1))),
        lambda n: F.concat(F.call_function("substring_index", head, F.lit("/"), n), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    if cuts:
        lengths = F.filter(F.array(*map(F.lit, cuts)), lambda n: n <= F.length(head))
        paths = F.array_union(paths, F.transform(lengths, lambda n: F.substring(head, F.lit(1), n)))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def _joined(left: DataFrame, right: DataFrame, rows: int, row_bytes: int, on: list[str], how: str) -> DataFrame:
    """``left`` joined to a counted table: broadcast below the byte bound, else
    by shuffle with each key of ``left`` dealt to :data:`SALTS` tasks."""
    side = small(right, rows, row_bytes)
    if side is not right:
        return left.join(side, on, how)
    left = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule`` (host and path of
    the winning rule, null without one) and ``verdict`` (the rule's, else
    ``default``).

    A null URL, or one without ``://``, has an empty host and path; no rule fits
    an empty host.  Keys are carried as they are, null and repeated ones
    included; repeated rows give equal rows, an empty table none, an empty rule
    table ``default`` for all."""
    known = checkpointed(prepared(rules))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max("host_len").alias("host"), F.max("path_len").alias("path"),
                     F.max(F.octet_length("rule")).alias("bytes")).first()
    urls = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    read = urls.select("k", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    if not size["n"]:
        return read.select(F.col("k").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    # rules that end inside a path segment: their lengths, at most the longest rule path
    cuts = [r[0] for r in known.where("path_len > 0 and not endswith(rule, '/')").select("path_len")
            .distinct().orderBy("path_len").collect()]
    dotted = F.concat(F.lit("."), F.col("host"))
    # no rule is longer, so nothing beyond can decide; a label that is cut through
    # cannot either, nor (unless a rule ends inside a segment) the path behind its last slash
    cut = read.select("k", "host", "path", F.right(dotted, F.lit(size["host"] + 1)).alias("tail"),
                      F.substring("path", 1, size["path"]).alias("head"))
    cut = cut.withColumn("tail", F.when(F.instr("tail", ".") > 0, F.substring(
        F.col("tail"), F.instr("tail", "."), F.lit(2**31 - 1))).otherwise(F.lit("")))
    if not cuts:
        cut = cut.withColumn("head", F.substring(F.col("head"), F.lit(1), F.length("head") - F.length(
            F.substring_index("head", "/", -1))))
    heads = cut.where("tail not in ('', '.')").select("tail", "head").distinct()
    made = heads.select("tail", "head", F.explode(F.array_distinct(
        expressions(F.col("tail"), F.col("head"), cuts))).alias("e"))
    made = made.select("tail", "head", F.sha2("e", 256).alias("full")).select(
        "tail", "head", "full", F.substring("full", 1, SHORT).alias("short"))
    hits = _joined(made, known, size["n"], 200 + size["bytes"], ["short"], "inner").where("full = digest")
    best = hits.groupBy("tail", "head").agg(F.max_by(
        F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_len"))).alias("won")).select(
        "tail", "head", "won.rule", "won.verdict")
    best = checkpointed(best)
    many = best.agg(F.count(F.lit(1)), F.max(F.octet_length("tail") + F.octet_length("head"))).first()
    out = _joined(cut, best, many[0], 300 + (many[1] or 0) + size["bytes"], ["tail", "head"], "left")
    return out.select(F.col("k").alias(key), "host", "path", "rule",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query (host, path, verdict).
RULES_SQL = """SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)"""


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(RULES_SQL))


OP13_SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(host, path, verdict)),
u AS (SELECT row_number() OVER () AS i, page_id,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT i, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT i, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
             arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""
