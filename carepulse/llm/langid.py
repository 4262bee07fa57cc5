"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with FTRL-proximal and an elastic net, calibrated by
one temperature.

Document frequencies cover every labelled training document.  The classifier is
fitted on at most about ``Fit.max_per_lang`` documents a language (a documented
bound, drawn by a hash of the id), in one task; prediction reads every whole
text.  Features are counted in a fixed number of hash buckets, so the model and
every table sent to the driver have a fixed size."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, batch, held_out, map_batches, table

UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    bits: int = 15              # 2**bits hash buckets
    max_n: int = 3              # characters of the longest n-gram
    max_per_lang: int = 1500    # training documents of a language (expected bound)
    max_langs: int = 256        # the most frequent languages are learned; bounds the weights
    epochs: int = 2
    alpha: float = 1.0          # FTRL step
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1e-4
    calibration: int = 5        # every fifth sampled document sets the temperature


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; runs of anything else become one
    blank, and one stands at both ends.  Empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    ok = _letters()[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.concatenate(([32], np.where(ok, c, 32), [32]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def features(text: str, cfg: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the character n-grams of the whole text."""
    c = letters_of(text).astype(np.uint64)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(1 << cfg.bits, np.int64)
    key = np.zeros(len(c), np.uint64)
    for n in range(1, cfg.max_n + 1):
        key = key[:len(c) - n + 1] * np.uint64(0x110001) + c[n - 1:]
        if not len(key):
            break
        mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((mixed >> np.uint64(64 - cfg.bits)).astype(np.int64),
                             minlength=1 << cfg.bits)
    at = np.flatnonzero(total)
    return at, total[at]


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, cfg: Fit) -> np.ndarray:
    """Weights (buckets x classes) after ``epochs`` passes over (buckets, values,
    class) in the given order; most are exactly zero."""
    z = np.zeros((1 << cfg.bits, classes))
    n = np.zeros_like(z)

    def weights(zz, nn):
        return np.where(np.abs(zz) <= cfg.l1, 0.0,
                        (np.sign(zz) * cfg.l1 - zz) / ((cfg.beta + np.sqrt(nn)) / cfg.alpha + cfg.l2))
    for _ in range(cfg.epochs):
        for at, x, y in rows:
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / cfg.alpha * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its
    logarithm; 1 without rows.  The targets allow for one error more than seen
    (as if (n + 1) of (n + 2) were right), so a faultless fold gives no 0 or 1."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    rest = 1 / (len(y) + 2)
    target = np.full(logits.shape, rest / (logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - rest

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum())
    a, b, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str, cfg: Fit) -> tuple[str, float]:
        at, counts = features(text, cfg)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = tfidf(counts, self.idf[at]) @ self.weights[at]
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def document_frequencies(docs: DataFrame, cfg: Fit) -> np.ndarray:
    """Documents by bucket, last: all documents with a letter; column ``text``."""
    size = 1 << cfg.bits

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for t in as_texts(b.slice(i, 256).column(0)):
                    at, _ = features(t, cfg)
                    if len(at):
                        total[at] += 1
                        total[size] += 1
        at = np.flatnonzero(total)
        yield batch(pa.array(at), pa.array(total[at]), names=["bucket", "n"])
    sums = docs.select("text").mapInArrow(run, "bucket bigint, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def fit(docs: DataFrame, cfg: Fit = Fit()) -> Model:
    """A model of columns ``key`` (any id), ``text`` and non-null ``lang``.  Of more
    than ``cfg.max_langs`` languages the most frequent are learned (of equals the
    first by name); documents of the others count in the document frequencies only."""
    size = 1 << cfg.bits
    most = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(cfg.max_langs)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.ones(size), np.zeros((size, 0)), 1.0)
    df = document_frequencies(docs, cfg)
    idf = np.log((1 + df[size]) / (1 + df[:size])) + 1
    # a hash threshold per language draws about max_per_lang of its documents
    share = F.create_map(*[F.lit(x) for k in langs
                           for x in (k, min(1.0, cfg.max_per_lang / counts[k]))])
    draw = F.xxhash64(F.col("key").cast("string"), F.lit("draw"))
    sample = docs.where(F.pmod(draw, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)) \
        .select("text", "lang", draw.alias("draw"))
    shared = docs.sparkSession.sparkContext.broadcast((langs, idf))

    def feature_rows():
        def step(b: pa.RecordBatch):
            got = [features(t, cfg) for t in as_texts(b.column(0))]
            return batch(b.column(1), b.column(2),
                         pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()),
                         pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary()),
                         names=["lang", "draw", "buckets", "counts"])
        return step

    def train(batches):
        names, weight = shared.value
        index = {k: i for i, k in enumerate(names)}
        rows = []
        for b in batches:
            for lang, draw_, at, counts_ in zip(*(c.to_pylist() for c in b.columns)):
                at = np.frombuffer(at, "<i4").astype(np.int64)
                if len(at):
                    rows.append((draw_, index[lang], at, tfidf(
                        np.frombuffer(counts_, "<i4").astype(float), weight[at])))
        rows.sort(key=lambda r: (r[0], r[1]))
        held = [r for r in rows if r[0] // (1 << 30) % cfg.calibration == 0]
        w = ftrl([(at, x, y) for d, y, at, x in rows if d // (1 << 30) % cfg.calibration],
                 len(names), cfg)
        logits = np.array([x @ w[at] for _, _, at, x in held]).reshape(-1, len(names))
        t = temperature(logits, np.array([y for _, y, _, _ in held], np.int64))
        flat = w.reshape(-1)
        at = np.flatnonzero(flat)
        yield batch(pa.array([at.astype("<i4").tobytes()], pa.binary()),
                    pa.array([flat[at].astype("<f8").tobytes()], pa.binary()), pa.array([t]),
                    names=["at", "weights", "temperature"])
    feats = map_batches(sample, "lang string, draw bigint, buckets binary, counts binary", feature_rows)
    row = feats.repartition(1).mapInArrow(train, "at binary, weights binary, temperature double").first()
    w = np.zeros(size * len(langs))
    w[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["weights"], "<f8")
    return Model(langs, idf, w.reshape(size, len(langs)), row["temperature"])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text",
            cfg: Fit = Fit()) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` per row.  A null text, or
    one without a letter, is ``und`` with score 0; so is every text when there
    was nothing to learn from."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1])
    names = [*keep, "lang_pred", "score"]

    def start():
        m = shared.value

        def step(b: pa.RecordBatch):
            got = [m.predict(t, cfg) for t in as_texts(b.column(len(keep)))]
            return batch(*b.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                         pa.array([g[1] for g in got], pa.float64()), names=names)
        return step
    return map_batches(rows, f"{schema}, lang_pred string, score double", start)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4)
    train = docs.where(~fold & F.col("lang").isNotNull()).select(
        F.col("doc_id").alias("key"), "text", "lang")
    rows = docs.select("doc_id", fold.alias("held_out"), "text")
    return predict(rows, fit(train), ["doc_id", "held_out"])
