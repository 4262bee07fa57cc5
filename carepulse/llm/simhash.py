"""SimHash near-duplicates with pivot distance tables.

1. A 64-bit fingerprint per document from the XXH64 of its word shingles.
2. Documents of one fingerprint collapse to one row (a map-side combined count),
   so copies never meet again until the result is joined back.
3. Fingerprints within ``max_bits`` agree on all but ``max_bits`` of ``blocks``
   bit blocks; each choice of equal blocks is a bucket key.  A bucket holds
   fingerprints, not documents, and buckets beyond ``bucket_rows`` are cut into
   chunks whose pairs are dealt to different tasks.
4. In a bucket each fingerprint has its Hamming distances to PIVOTS reference
   fingerprints.  By the triangle inequality two fingerprints whose distances to
   one reference differ by more than ``max_bits`` cannot link: that discards
   nearly all pairs, and the survivors' distance is computed.
5. Links become components by alternating star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from .common import as_bytes, batch, checkpointed, map_batches, parked, table

SEED = 42
PIVOTS = 16
BUCKET_ROWS = 20_000
#: Fingerprints of a component above which it is not gathered in a task.
HOT_ROWS = 1000
#: Reference fingerprints, made by rule.
PIVOT_TABLE = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED)
                        for i in range(PIVOTS)], np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is 1 if set in over half of the shingle hashes (repeats included);
    A-Z are lower-cased; a text without words has fingerprint 0."""
    words = text.lower().split()          # bytes: ASCII letters and blanks only
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.zeros(n, np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    end = start + size
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(
        start[:n - shingle + 1].tolist(), end[shingle - 1:].tolist())], np.uint64)
    # "over half": 2 * ones > shingles, bit by bit
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 shingle: int = 4) -> DataFrame:
    """``id, fp`` (fp: the fingerprint as a signed long) per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))

    def start():
        def step(b: pa.RecordBatch):
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], np.uint64)
            return batch(b.column(0), pa.array(fp.view(np.int64)), names=["id", "fp"])
        return step
    return map_batches(rows, "id bigint, fp bigint", start)


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``blocks`` nearly equal parts of 64 bits."""
    at = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def blocks_for(n: int, max_bits: int) -> int:
    """Fewest blocks whose bucket keys outnumber the fingerprints: the bucket
    size stays near one for unrelated fingerprints at every table size."""
    m = max_bits + 2
    while m < max_bits + 6 and 2 ** (64 * (m - max_bits) / m) < n:
        m += 1
    return m


def link_run(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(root, member) positions that connect the linked fingerprints of a run:
    breadth first, each step against those not reached yet, which the pivot
    table narrows before any distance is computed."""
    n = len(fp)
    dist = np.bitwise_count(fp[:, None] ^ PIVOT_TABLE[None, :]).astype(np.int8)
    order = np.argsort(dist[:, 0], kind="stable")     # first coordinate: a range
    fp, dist = fp[order], dist[order]
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    root = -1
    while len(left):
        if queue:
            u = queue.pop()
        else:
            u, left = int(left[0]), left[1:]
            root = u
            if not len(left):
                break
        first = dist[left, 0]
        a = np.searchsorted(first, dist[u, 0] - max_bits, "left")
        b = np.searchsorted(first, dist[u, 0] + max_bits, "right")
        near = left[a:b]
        for k in range(1, PIVOTS):
            if not len(near):
                break
            near = near[np.abs(dist[near, k] - dist[u, k]) <= max_bits]
        if len(near):
            near = near[np.bitwise_count(fp[near] ^ fp[u]) <= max_bits]
        if len(near):
            out += [(int(order[root]), int(order[v])) for v in near]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _link_runs(key: np.ndarray, fp: np.ndarray, max_bits: int):
    """Links of all runs of equal ``key`` (sorted): short runs by shifted
    comparison of the whole array, long ones one by one."""
    a_out, b_out = [], []
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    lo = np.concatenate(([0], change))
    size = np.diff(np.concatenate((lo, [len(key)])))
    short = np.repeat(size <= 32, size)
    if short.any():
        k, f = key[short], fp[short]
        d = np.bitwise_count(f[:, None] ^ PIVOT_TABLE[None, :]).astype(np.int8)
        for shift in range(1, 32):
            i = np.flatnonzero(k[shift:] == k[:-shift])
            if not len(i):
                break
            for c in range(PIVOTS):
                i = i[np.abs(d[i, c] - d[i + shift, c]) <= max_bits]
            i = i[np.bitwise_count(f[i] ^ f[i + shift]) <= max_bits]
            a_out.append(f[i])
            b_out.append(f[i + shift])
    for r in np.flatnonzero(size > 32):
        run = fp[lo[r]:lo[r] + size[r]]
        got = np.array(link_run(run, max_bits), np.int64).reshape(-1, 2)
        a_out.append(run[got[:, 0]])
        b_out.append(run[got[:, 1]])
    if not a_out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a_out), np.concatenate(b_out)


def links(fps: DataFrame, max_bits: int = 4, blocks: int | None = None,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a, b`` (a < b) between the distinct values of column ``fp`` that
    connect exactly the fingerprints connected by pairs within ``max_bits``."""
    blocks = blocks or blocks_for(fps.count(), max_bits)
    edges = block_edges(blocks)
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << w) - 1) << a for a, w in (edges[c] for c in chosen))
        keys.append(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(
            F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.c", "k.bits")
    # buckets beyond the bound are cut into chunks; each pair of chunks is a cell
    hot = checkpointed(rows.groupBy("c", "bits").count().where(F.col("count") > bucket_rows)
                       .withColumn("chunks", F.ceil(F.col("count") / bucket_rows).cast("int"))
                       .drop("count"))
    zero = F.lit(0)
    cells = rows.withColumns({"x": zero, "y": zero})
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
        cut = rows.join(hot, ["c", "bits"], "left")
        cells = cut.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own) \
            .withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1))) \
            .select("fp", "c", "bits", F.least("own", "other").alias("x"),
                    F.greatest("own", "other").alias("y"))
    dealt = cells.repartition("c", "bits", "x", "y").sortWithinPartitions("c", "bits", "x", "y")

    def run(batches):
        held = None                      # rows of the last key, until it is complete
        def emit(part):
            change = (part[1:, :4] != part[:-1, :4]).any(axis=1)
            key = np.concatenate(([0], np.cumsum(change)))
            a, b = _link_runs(key, part[:, 4].astype(np.int64).view(np.uint64), max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return batch(pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), names=["a", "b"])
        for b in batches:
            part = np.stack([b.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
                             for x in ("c", "bits", "x", "y", "fp")], axis=1)
            if not len(part):
                continue
            if held is not None:
                part = np.concatenate((held, part))
            last = np.flatnonzero((part[:, :4] != part[-1, :4]).any(axis=1))
            split = int(last[-1]) + 1 if len(last) else 0
            if split:
                yield emit(part[:split])
            held = part[split:]
        if held is not None and len(held):
            yield emit(held)
    out = dealt.select("c", "bits", "x", "y", "fp").mapInArrow(run, "a bigint, b bigint")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of the component) for every node of
    the links ``a, b``: alternating large and small stars until every component
    is a star.  Each round shuffles the links only."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    def state(x):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of u's neighbourhood
        e = both.where("v > u").join(least, F.col("u") == F.col("w")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        e = e.join(least, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")) \
            .select("x.u", "x.v").where("u <> v").distinct()
        e = checkpointed(e)
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _named_components(named: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``f, component_id, root`` of the members ``fp, least, root``.  The members of
    components above ``hot_rows``, of which there are few, are not brought
    together: their components' ids are broadcast within a measured size."""
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    hot = ids.where(F.col("n") > hot_rows).select(
        "root", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = join_counted(named, hot, ["root"], "left")
    large = marked.where("hot").select(F.col("fp").alias("f"), F.col("hot_id").alias("component_id"), "root")
    small = marked.where("hot is null").join(ids, "root")
    return large.unionByName(small.select(F.col("fp").alias("f"), "component_id", "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = 4, max_bits: int = 4, blocks: int | None = None,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id, fp, component_id, root`` per row (root: the component's least
    fingerprint, which names it even without ids): component_id is the smallest id of the
    documents reachable over links of ``max_bits`` or fewer bits.

    A null or blank text has fingerprint 0 and links like any other; repeated
    rows stay; rows with a null id are members but never give the component id
    (null if all ids of the component are null)."""
    rows = checkpointed(fingerprints(docs, id_col, text, shingle))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    comp = checkpointed(components(links(fps.select("fp"), max_bits, blocks, bucket_rows)))
    named = checkpointed(fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", "root"))
    alone = named.where("root is null").select(
        F.col("fp").alias("f"), F.col("least").alias("component_id"), F.col("fp").alias("root"))
    by_fp = alone.unionByName(_named_components(named.where("root is not null")))
    return rows.join(by_fp, F.col("fp") == F.col("f")).select("id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id (of repeated rows with that id one stays).  A component of null ids only
    also keeps one row."""
    docs, back = parked(docs, [id_col, text])
    cols = docs.columns
    groups = checkpointed(near_duplicates(docs, id_col, text, **kw))
    # an id used for several texts may go from one component and name another,
    # so repeated ids and null ids, which are rare, are settled by fingerprint
    odd = groups.groupBy("id").count().where("count > 1 or id is null")
    odd = checkpointed(odd.select(F.col("id").alias("__odd")))
    key = F.col(id_col).cast("bigint")
    gone = groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone")).distinct()
    if odd.isEmpty():
        return docs.join(gone, key == F.col("__gone"), "left_anti").withColumnsRenamed(back)
    rare = docs.join(odd, key.eqNullSafe(F.col("__odd")), "left_semi")
    plain = docs.join(odd, key.eqNullSafe(F.col("__odd")), "left_anti") \
        .join(gone, key == F.col("__gone"), "left_anti")
    return plain.unionByName(_settle(rare, groups, id_col, text, kw.get("shingle", 4))).select(*cols) \
        .withColumnsRenamed(back)


def _settle(rare: DataFrame, groups: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """One row of each component among rows whose ids repeat or are null."""
    cols = rare.columns

    def start():
        def step(b: pa.RecordBatch):
            i = b.schema.get_field_index(text)
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(i))], np.uint64)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))],
                                              names=[*b.schema.names, "__fp"])
        return step
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rare.schema)
    marked = map_batches(rare, schema + ", __fp bigint", start)
    comp = groups.groupBy(F.col("fp").alias("__f")).agg(
        F.first("component_id").alias("__c"), F.first("root").alias("__root"))
    marked = marked.join(comp, F.col("__fp") == F.col("__f"))
    first = marked.where(F.col(id_col).cast("bigint").eqNullSafe(F.col("__c")))
    ranked = first.groupBy("__root").agg(
        F.min(F.struct(F.xxhash64(*cols).alias("h"), *cols)).alias("row"))
    return ranked.select("row.*").select(*cols)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"),
                      F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
