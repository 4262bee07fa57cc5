"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a query set: its different items are dealt by hash to blocks of
about ``BLOCK_WORDS`` words, and ``LIVE_BLOCKS`` of them at a time are indexed,
broadcast and searched in one pass over the documents.  What the driver and the
tasks hold is bounded by such a round, not by the benchmark.  A benchmark of one
round is a plain map over the documents; of several, each round leaves its leaks
by the digest of the text, its broadcasts are destroyed, and the few texts with
leaks are joined back at the end.  No text is shuffled while searching.

1. Corpus counts: how often each word of the round's items occurs (all documents;
   summed per task, then by one small aggregation).
2. Seeds of an item are its n-grams that chance would put into at most
   ``rare_share`` as many places as there are documents (words taken as
   independent), and always those not above the median of the item's own.  Their
   own counts are not used: an item, or an edited copy of it, that leaked into a
   third of the corpus keeps its seeds.
3. Seed hits near each other on one item open a window of the document; the
   local alignment of window and item (word by word: match +2, mismatch and gap
   -1) over the item's perfect score is the leak's score.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_texts, batch, checkpointed, map_batches, parked, table

#: Words of a benchmark block: its index and seeds stay under about 100 bytes a word.
BLOCK_WORDS = 200_000
#: Blocks that are broadcast and searched together.
LIVE_BLOCKS = 4
#: Tasks that a text's rows are dealt to where the leaks found are too many to broadcast.
SALTS = 32
_MARKS = b".,;:!?\"'()[]{}"
_BLANKED = bytes.maketrans(_MARKS, b" " * len(_MARKS))


@dataclass(frozen=True)
class Leak:
    n: int = 3                  # words of a seed
    rare_share: float = 0.001   # expected places of a seed, by documents
    min_seeds: int = 2          # different seeds of an item in a window (if it has as many)
    slack: int = 10             # words added to a window on both sides, beside the item's length
    min_score: float = 0.5      # of the item's perfect alignment score


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between blanks and punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKED).split()


class Index:
    """A block of items: words as numbers, and n-grams as one number each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for key, text in items:
            w = words_of(text)
            if w:
                ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
                self.items.append((key, np.array(ids, np.int64)))
        self.base = len(self.vocab) + 2           # 0: a word of no item
        if self.base ** n >= 2 ** 62:
            raise ValueError("block too large for its n-gram length")
        grams = [self.grams(ids) for _, ids in self.items]
        self.keys = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.where = [np.searchsorted(self.keys, g) for g in grams]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """One number per n-gram; an item or text shorter than n is one n-gram."""
        k = min(self.n, len(ids))
        out = np.zeros(len(ids) - k + 1, np.int64)
        for i in range(k):
            out = out * self.base + ids[i:len(ids) - k + 1 + i]
        return out

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, n-gram number) of the benchmark n-grams in a text, shorter
        ones for items of fewer than n words included."""
        at, which = [], []
        for k in self.lengths:
            if len(ids) < k:
                continue
            m = len(ids) - k + 1
            full = ids[:m] > 0
            for i in range(1, k):
                full &= ids[i:m + i] > 0
            pos = np.flatnonzero(full)
            if not len(pos):
                continue
            key = np.zeros(len(pos), np.int64)
            for i in range(k):
                key = key * self.base + ids[pos + i]
            j = np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(j, len(self.keys) - 1)] == key
            at.append(pos[ok])
            which.append(j[ok])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(which)

    @property
    def lengths(self) -> list[int]:
        return sorted({min(self.n, len(ids)) for _, ids in self.items})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))


class Seeds:
    """Seeds of a block: for each n-gram number the items that use it as a seed."""

    def __init__(self, index: Index, words: np.ndarray, documents: int, cfg: Leak):
        """``words``: corpus counts by word number; 0 is every other word."""
        total = max(1, int(words.sum()))
        expected, rest = np.full(len(index.keys), float(total)), index.keys.copy()
        share = np.maximum(words, 1) / total
        share[0] = 1.0                          # no word: the n-gram is shorter
        for _ in range(index.n):
            expected *= share[rest % index.base]
            rest //= index.base
        pairs: list[tuple[int, int, int]] = []
        self.needed = []
        for i, where in enumerate(index.where):
            limit = max(cfg.rare_share * documents, float(np.median(expected[where])))
            chosen = {g for g in where.tolist() if expected[g] <= limit}
            pairs += [(g, i, p) for p, g in enumerate(where.tolist()) if g in chosen]
            self.needed.append(min(cfg.min_seeds, len(chosen)))
        pairs.sort()
        table_ = np.array(pairs, np.int64).reshape(-1, 3)
        self.item, self.offset = table_[:, 1], table_[:, 2]
        self.lo = np.searchsorted(table_[:, 0], np.arange(len(index.keys)), "left")
        self.hi = np.searchsorted(table_[:, 0], np.arange(len(index.keys)), "right")


def align(item: np.ndarray, window: np.ndarray) -> int:
    """Best Smith-Waterman score (match +2, mismatch -1, gap -1); 0 in
    ``window`` is a word that matches nothing."""
    step = np.arange(len(window) + 1)
    row, best = np.zeros(len(window) + 1, np.int64), 0
    for w in item.tolist():
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(window == w, 2, -1), out=new[1:])
        # gaps along the row: the running maximum of score plus distance
        row = np.maximum.accumulate(new + step) - step
        np.maximum(row, 0, out=row)
        best = max(best, int(row.max()))
    return best


def leaks(index: Index, seeds: Seeds, ids: np.ndarray, cfg: Leak) -> list[tuple[int, float]]:
    """(item key, score) of the items that leaked into a text; a key may be null."""
    pos, gram = index.hits(ids)
    if not len(pos):
        return []
    counts = seeds.hi[gram] - seeds.lo[gram]
    if not counts.any():
        return []
    p = np.repeat(pos, counts)
    g = np.repeat(gram, counts)
    k = np.repeat(seeds.lo[gram] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) \
        + np.arange(counts.sum())
    item = seeds.item[k]
    order = np.lexsort((p, item))
    p, g, item = p[order], g[order], item[order]
    out = []
    edges = np.flatnonzero(np.diff(item)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(item)]):
        i = int(item[a])
        key, words = index.items[i]
        reach, best = len(words) + cfg.slack, 0
        if b - a < seeds.needed[i]:
            continue
        cut = np.flatnonzero(np.diff(p[a:b]) > reach) + 1
        for c, d in zip([0, *cut.tolist()], [*cut.tolist(), b - a]):
            if len(np.unique(g[a + c:a + d])) >= seeds.needed[i]:
                lo, hi = int(p[a + c]), int(p[a + d - 1])
                best = max(best, align(words, ids[max(0, lo - reach):hi + index.n + reach]))
        score = best / (2 * len(words))
        if score >= cfg.min_score:
            out.append((key, score))
    return out


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """``key, item, block`` of the different items, and the number of blocks.  Null
    and blank items are left out: they have no words to leak; texts of one id are
    separate items, equal rows are one."""
    words = F.size(F.split(F.translate(text, _MARKS.decode(), " " * len(_MARKS)), r"\s+"))
    items = checkpointed(benchmark.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("key"), F.col(text).alias("item"), words.alias("words")).distinct())
    total = items.agg(F.sum("words")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    return items.select("key", "item", F.pmod(F.xxhash64("key", "item"), F.lit(max(1, blocks))).alias("block")), blocks


def corpus_counts(docs: DataFrame, text: str, shared) -> tuple[list[np.ndarray], int]:
    """How often each word of a round's blocks occurs in all documents (by block;
    number 0: all other words), and the documents."""
    sizes = [x.base for x in shared.value]

    def run(batches):
        indexes, documents = shared.value, 0
        totals = [np.zeros(x.base, np.int64) for x in indexes]
        for b in batches:
            documents += b.num_rows
            for i in range(0, b.num_rows, 256):
                for t in as_texts(b.slice(i, 256).column(0)):
                    w = words_of(t)
                    for idx, total in zip(indexes, totals):
                        ids = idx.numbers(w)
                        if len(ids) > idx.base:
                            total += np.bincount(ids, minlength=idx.base)
                        else:
                            np.add.at(total, ids, 1)
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield batch(pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at]), names=["block", "word", "n"])
        yield batch(pa.array([-1]), pa.array([0]), pa.array([documents]), names=["block", "word", "n"])
    sums = docs.select(F.col(text).alias("t")).mapInArrow(run, "block bigint, word bigint, n bigint") \
        .groupBy("block", "word").agg(F.sum("n").alias("n")).toArrow()
    block, word, n = (sums.column(c).to_numpy() for c in ("block", "word", "n"))
    out = [np.zeros(size, np.int64) for size in sizes]
    for k, counts in enumerate(out):
        counts[word[block == k]] = n[block == k]
    return out, int(n[block == -1].sum())


HIT = "array<struct<item_id:bigint,score:double>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
               item_id: str = "item_id", item_text: str = "text",
               cfg: Leak = Leak(), out: str = "leaks") -> DataFrame:
    """Columns ``keep`` and ``out`` (items and scores, by item id) per row of
    ``docs``.  Null and empty texts have none; an empty benchmark gives none;
    repeated rows are each judged, repeated items once.  An item of fewer than
    ``cfg.n`` words is its own seed: a text that holds it word for word, side by
    side, has it, also if it is one common word.  ``out`` must not be one of ``keep``."""
    if out in keep:
        raise ValueError(f"column {out} is there already")
    own = {c: f"_parked_{i}" for i, c in enumerate(keep)}
    items, blocks = benchmark_items(benchmark, item_id, item_text)
    rounds = [range(lo, min(lo + LIVE_BLOCKS, blocks)) for lo in range(0, blocks, LIVE_BLOCKS)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(text).alias("__text"))
    if len(rounds) > 1:
        rows = _join_leaks(rows, [_round_leaks(docs, text, items, r, cfg) for r in rounds])
    else:
        rows = rows.withColumn("__leaks", F.array().cast(HIT))
        for r in rounds:
            rows = _search(rows, *_broadcast(docs, text, items, r, cfg), cfg)
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()], F.array_sort("__leaks").alias(out))


def _broadcast(docs: DataFrame, text: str, items: DataFrame, blocks: range, cfg: Leak):
    """Broadcasts of the blocks' indexes and of their seeds."""
    sc, held = docs.sparkSession.sparkContext, {k: [] for k in blocks}
    for key, item, block in items.where(F.col("block").isin(*blocks)).collect():
        held[block].append((key, item))
    indexes = sc.broadcast([x for x in (Index(own, cfg.n) for own in held.values()) if x.items])
    counts, documents = corpus_counts(docs, text, indexes)
    return indexes, sc.broadcast([Seeds(x, n, documents, cfg) for x, n in zip(indexes.value, counts)])


def _search(rows: DataFrame, indexes, seeds, cfg: Leak) -> DataFrame:
    """``rows`` with the leaks of the broadcast blocks added to the last column,
    ``__leaks``; the text is the column before it."""
    def start():
        blocks = list(zip(indexes.value, seeds.value))

        def step(b: pa.RecordBatch):
            texts = map(words_of, as_texts(b.column(b.num_columns - 2)))
            found = [[hit for idx, own in blocks for hit in leaks(idx, own, idx.numbers(w), cfg)] for w in texts]
            if not any(found):
                return b
            last = b.num_columns - 1
            new = [[{"item_id": k, "score": s} for k, s in f] for f in found]
            return b.set_column(last, b.schema.field(last), pa.array(new, b.schema.field(last).type))
        return step
    return map_batches(rows, rows.schema, start)


def _digest(text: str):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _round_leaks(docs: DataFrame, text: str, items: DataFrame, blocks: range, cfg: Leak) -> DataFrame:
    """``__digest, __leaks`` of the texts into which items of these blocks leaked, one
    row a text, written to the checkpoint folder: nothing of the round stays in memory."""
    shared = _broadcast(docs, text, items, blocks, cfg)
    rows = docs.select(F.col(text).alias("__text"), F.array().cast(HIT).alias("__leaks"))
    found = _search(rows, *shared, cfg).where(F.size("__leaks") > 0) \
        .groupBy(_digest("__text").alias("__digest")).agg(F.first("__leaks").alias("__leaks"))
    found = checkpointed(found)
    for x in shared:
        x.destroy()
    return found


def _join_leaks(rows: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``rows`` and ``__leaks`` of all rounds, by text: a broadcast join within the
    counted size, else both sides salted, so that a text with very many copies is
    dealt to many tasks."""
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    found = checkpointed(found.groupBy("__digest").agg(F.flatten(F.collect_list("__leaks")).alias("__leaks")))
    size = found.agg(F.sum(F.lit(128) + 32 * F.size("__leaks"))).first()[0] or 0
    rows = rows.withColumn("__key", _digest("__text"))
    on = F.col("__key") == F.col("__digest")
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    else:
        rows = rows.withColumn("__salt", F.monotonically_increasing_id() % SALTS)
        found = found.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on &= F.col("__salt") == F.col("__slot")
    return rows.join(found, on, "left").withColumn("__leaks", F.coalesce("__leaks", F.array().cast(HIT)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", cfg: Leak = Leak()) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaked."""
    rows, back = parked(docs, [text])
    found = find_leaks(rows, benchmark, rows.columns, text, cfg=cfg, out="_found")
    return found.where(F.size("_found") == 0).drop("_found").withColumnsRenamed(back)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"),
        F.array_distinct(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["score"])), F.lit(0.0)).alias("best_score"))
