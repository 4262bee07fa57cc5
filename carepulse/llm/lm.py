"""Language-model scoring of whole documents.

1. Documents are cut into blocks (whole documents, a bounded number of tokens
   and of different words); a block lists each of its words once, so the corpus
   counts and their way back are shuffled per block and word, not per token.
2. Word counts over all training documents; the ``words`` most frequent get
   numbers in the network, the rest share the class of rare words, inside which
   a word has probability (c + 1) / (rare tokens + rare words + 1).
3. Every task trains the network of ``gru.py`` on all training documents of its
   blocks from a common start; parameters are averaged, weighted by tokens, by
   sums over ever fewer partitions.  A round over every ``warm_up``-th document
   makes the common start.
4. Each document is scored whole: the state is carried from window to window.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpointed, held_out, table, written
from .gru import Gru

END, RARE = 0, 1


@dataclass(frozen=True)
class Lm:
    words: int = 1024           # with a number of their own in the network
    hidden: int = 12
    rate: float = 0.1
    block_tokens: int = 1_000_000
    block_words: int = 200_000
    train_every: int = 1        # the network is fitted on every training document;
    warm_up: int = 24           # the first round, which makes the start, on every 24th
    fan_in: int = 16            # parameter vectors summed by a task
    chunk_tokens: int = 1_500_000   # tokens that the network handles side by side


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


BLOCK = ("block bigint, ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, "
         "words array<string>, train array<bigint>")


def blocks(docs: DataFrame, cfg: Lm) -> DataFrame:
    """Blocks of columns ``id, held, text``: ``words`` are the different words of
    a block, ``train`` their counts in its training documents, ``tokens`` the
    documents' words as places in ``words``."""
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        held: list = []

        def emit(place):
            ids, flags, tokens = zip(*held)
            flat = np.concatenate(tokens)
            lengths = np.array([len(t) for t in tokens], np.int32)
            learned = np.repeat(~np.array(flags, bool), lengths)
            train = np.bincount(flat[learned], minlength=len(place)) if len(place) else []
            return batch(
                pa.array([next(number)], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([list(flags)], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([_pack(flat)], pa.binary()),
                pa.array([pa.array(list(place), pa.binary()).cast(pa.string())], pa.list_(pa.string())),
                pa.array([train], pa.list_(pa.int64())), names=names)

        place, size = defaultdict(count().__next__), 0
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                for key, flag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                           as_bytes(part.column(2))):
                    words = text.decode("utf-8", "replace").encode().lower().split()
                    tokens = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
                    held.append((key, flag, tokens))
                    size += len(tokens) + 1
                    if size >= cfg.block_tokens or len(place) >= cfg.block_words:
                        yield emit(place)
                        held.clear()
                        place, size = defaultdict(count().__next__), 0
        if held:
            yield emit(place)
    return docs.select(F.col("id").cast("bigint"), "held", "text").mapInArrow(run, BLOCK)


@dataclass
class Totals:
    tokens: int                 # N: training tokens, ends included
    words: int                  # V: different training tokens, the end included
    ends: int                   # training documents
    top: list[tuple[str, int]]  # the frequent words and their counts


def totals(cut: DataFrame, counts: DataFrame, cfg: Lm) -> Totals:
    ends = cut.select(F.size(F.filter("held", lambda h: ~h)).alias("n")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(cfg.words).collect()
    return Totals(n + ends, v + (ends > 0), ends, [(r["word"], r["c"]) for r in top])


PREPARED = ("ids array<bigint>, held array<boolean>, lengths array<int>, known array<bigint>, "
            "base array<double>, rare array<double>, tokens binary")


def prepare(cut: DataFrame, counts: DataFrame, t: Totals) -> DataFrame:
    """Blocks with network numbers for tokens (an end after each document), the
    base scores, and each document's log10 sum inside the class of rare words."""
    names = [x.split()[0] for x in PREPARED.split(", ")]
    frequent = [w for w, _ in t.top]
    number = {w: (c, i + 2) for i, (w, c) in enumerate(t.top)}
    # frequent words stand in most blocks: they are looked up in the task, so no
    # key of the join grows with the number of blocks of a common word
    tail = cut.select(F.col("block").alias("b"), F.posexplode("words").alias("pos", "word")) \
        .where(~F.col("word").isin(frequent))
    found = tail.join(counts.hint("shuffle_hash"), "word").select("b", "pos", "c")
    body = cut.select("block", "ids", "held", "lengths", "tokens", F.size("words").alias("n"), F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))),
        lambda x: x["word"].isin(frequent)).alias("top"))
    in_top = sum(c for _, c in t.top)
    rare_norm = float(np.log10(max(0, t.tokens - t.ends - in_top) + max(0, t.words - len(t.top)) + 1))
    norm = float(np.log10(t.tokens + t.words + 1))
    ends = t.ends

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        c, k = np.zeros(row["n"], np.int64), np.full(row["n"], RARE, np.int16)
        if left.num_rows:
            c[left.column("pos").to_numpy()] = left.column("c").to_numpy()
        for x in row["top"]:
            c[x["pos"]], k[x["pos"]] = number[x["word"]]
        lengths = np.array(row["lengths"], np.int64)
        flat = _unpack(row["tokens"], "<i4")
        doc = np.repeat(np.arange(len(lengths)), lengths)

        def by_doc(values):
            return np.bincount(doc, weights=values, minlength=len(lengths))
        logs = np.log10(c + 1.0)
        base = by_doc(logs[flat]) + np.log10(ends + 1.0) - (lengths + 1) * norm
        rare = by_doc(np.where(k == RARE, logs - rare_norm, 0.0)[flat])
        seen = by_doc((c > 0)[flat]).astype(np.int64) + (ends > 0)
        tokens = np.full(len(flat) + len(lengths), END, np.int16)
        tokens[np.arange(len(flat)) + doc] = k[flat]
        return pa.table([
            pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["held"]], pa.list_(pa.bool_())),
            pa.array([(lengths + 1).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([seen], pa.list_(pa.int64())), pa.array([base], pa.list_(pa.float64())),
            pa.array([rare], pa.list_(pa.float64())), pa.array([_pack(tokens)], pa.binary())], names=names)
    some = body.where(F.exists("lengths", lambda n: n > 0))
    none = body.where(~F.exists("lengths", lambda n: n > 0))       # blocks without a word
    out = found.groupBy("b").cogroup(some.groupBy("block")).applyInArrow(join, PREPARED)
    blank = F.size("ids")
    return out.unionByName(none.select(
        "ids", "held", F.array_repeat(F.lit(1), blank).alias("lengths"),
        F.array_repeat(F.lit(int(ends > 0)).cast("bigint"), blank).alias("known"),
        F.array_repeat(F.lit(float(np.log10(ends + 1.0) - norm)), blank).alias("base"),
        F.array_repeat(F.lit(0.0), blank).alias("rare"), F.lit(None).cast("binary").alias("tokens")))


def _tokens(packed: bytes | None, lengths: np.ndarray) -> np.ndarray:
    if packed is None:
        return np.full(len(lengths), END, np.int64)
    return _unpack(packed, "<i2").astype(np.int64)


def _chosen(tokens, lengths, use):
    return tokens[np.repeat(use, lengths)], lengths[use]


def train_round(prepared: DataFrame, start: np.ndarray, words: int, cfg: Lm, every: int) -> np.ndarray:
    """Parameters after each task's pass over every ``every``-th of its training
    documents from ``start``, averaged with the tokens as weights."""
    sc = prepared.sparkSession.sparkContext
    shared = sc.broadcast(start)

    def run(batches):
        model = Gru(words, cfg.hidden, flat=shared.value.copy())
        seen = np.full(model.flat.size, 1e-5, np.float32)
        total, learned = 0, 0
        chunk: list = []

        def train():
            model.train(*(np.concatenate(x) for x in zip(*chunk)), seen, cfg.rate)
            chunk.clear()
        for b in batches:
            for i in range(b.num_rows):
                held, lengths, packed = (c[0].as_py() for c in b.slice(i, 1).columns)
                lengths = np.array(lengths, np.int64)
                use = ~np.array(held, bool)
                use &= (np.cumsum(use) + learned) % every == 0
                learned += len(use) - int(np.sum(held))
                chunk.append(_chosen(_tokens(packed, lengths), lengths, use))
                total += len(chunk[-1][0])
                if sum(len(t) for t, _ in chunk) >= cfg.chunk_tokens:
                    train()
        if chunk:
            train()
        if total:
            yield batch(pa.array([(model.flat.astype(np.float64) * total).tobytes()], pa.binary()),
                        pa.array([total], pa.int64()), names=["flat", "tokens"])

    def add(batches):
        flat, total = 0.0, 0
        for b in batches:
            for f, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat, total = flat + np.frombuffer(f), total + n
        if total:
            yield batch(pa.array([flat.tobytes()], pa.binary()), pa.array([total], pa.int64()),
                        names=["flat", "tokens"])
    kind = "flat binary, tokens bigint"
    sums = prepared.select("held", "lengths", "tokens").mapInArrow(run, kind)
    sums = checkpointed(sums)
    parts = sums.rdd.getNumPartitions()
    while parts > cfg.fan_in:
        parts = -(-parts // cfg.fan_in)
        sums = sums.repartition(parts).mapInArrow(add, kind)
    flat, total = np.zeros(len(start)), 0
    for f, n in sums.toLocalIterator():
        flat, total = flat + np.frombuffer(bytes(f)), total + n
    return (flat / total).astype(np.float32) if total else start


def fit(prepared: DataFrame, t: Totals, cfg: Lm) -> Gru:
    words = len(t.top)
    model = Gru(words, cfg.hidden)
    counts = np.array([t.ends, t.tokens - t.ends - sum(c for _, c in t.top), *(c for _, c in t.top)])
    logs = np.log(counts + 1.0)
    model.start_from((logs - logs.max()).astype(np.float32))
    flat = train_round(prepared, model.flat, words, cfg, cfg.warm_up)
    flat = train_round(prepared, flat, words, cfg, cfg.train_every)
    return Gru(words, cfg.hidden, flat=flat)


SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
          "score double")


def score_blocks(prepared: DataFrame, model: Gru, cfg: Lm) -> DataFrame:
    shared = prepared.sparkSession.sparkContext.broadcast((model.words, model.flat))
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        words, flat = shared.value
        net = Gru(words, cfg.hidden, flat=flat)
        chunk: list = []                 # blocks, scored side by side

        def emit():
            ids, held, lengths, known, base, rare, tokens = (list(x) for x in zip(*chunk))
            chunk.clear()
            lengths = np.concatenate(lengths)
            score = net.score(np.concatenate(tokens), lengths) + np.concatenate(rare)
            return batch(pa.array(sum(ids, []), pa.int64()), pa.array(sum(held, []), pa.bool_()),
                         pa.array(lengths), pa.array(sum(known, []), pa.int64()),
                         pa.array(np.concatenate(base)), pa.array(score), names=names)
        for b in batches:
            for i in range(b.num_rows):
                ids, held, lengths, known, base, rare, packed = (c[0].as_py() for c in b.slice(i, 1).columns)
                lengths = np.array(lengths, np.int64)
                chunk.append((ids, held, lengths, known, np.array(base, float), np.array(rare, float),
                              _tokens(packed, lengths)))
                if sum(len(c[-1]) for c in chunk) >= cfg.chunk_tokens:
                    yield emit()
        if chunk:
            yield emit()
    return prepared.mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, cfg: Lm = Lm()) -> DataFrame:
    """SCORED and ``train_tokens`` for each row of columns ``id, held, text``
    (``held``: not learned from).  A null or blank text is one end token; a null
    id stays null; repeated rows are scored alike and learned from each time; an
    empty table gives an empty result; with nothing to learn from the network
    stays at its start."""
    cut, drop_cut = written(blocks(docs, cfg))
    counts, drop_counts = written(
        cut.select(F.explode(F.arrays_zip("words", "train")).alias("x"))
        .groupBy(F.col("x.words").alias("word")).agg(F.sum("x.train").alias("c")))
    t = totals(cut, counts, cfg)
    prepared = checkpointed(prepare(cut, counts, t))
    drop_cut()
    drop_counts()
    model = fit(prepared, t, cfg)
    return score_blocks(prepared, model, cfg).withColumn("train_tokens", F.lit(t.tokens).cast("bigint"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_scores(docs.select(F.col("doc_id").alias("id"),
                                held_out(F.col("doc_id"), 7).alias("held"), "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
