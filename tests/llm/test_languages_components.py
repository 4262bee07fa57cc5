"""Language identification against a plain version; members of large components."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from carepulse.llm import langid, simhash
from llm_helpers import make_docs  # noqa: F401

CFG = langid.Fit(bits=9, max_n=2, max_per_lang=10_000, epochs=2, l1=0.01)
VOCABULARY = {"aa": "ka lo mi tu ra", "bb": "sch ten und ber zu", "cc": "the of ing and to"}


def documents(n=90):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = sorted(VOCABULARY)[i % 3]
        words = VOCABULARY[lang].split() + ["x", "Yz", "1.5"]
        rows.append((i, " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 9))), lang))
    return rows + [(1000, "", "aa"), (1001, "12 34", "bb"), (1002, None, "cc")]


def slow_grams(text):
    """Buckets and counts by characters, one at a time."""
    chars = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not chars.split():
        return {}
    chars = " " + " ".join(chars.split()) + " "
    out, mask = Counter(), (1 << 64) - 1
    for n in range(1, CFG.max_n + 1):
        for i in range(len(chars) - n + 1):
            key = 0
            for c in chars[i:i + n]:
                key = (key * 0x110001 + ord(c)) & mask
            out[((key ^ key >> 31) * 0x9E3779B97F4A7C15 & mask) >> 64 - CFG.bits] += 1
    return out


def slow_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def slow_model(rows):
    grams = {i: slow_grams(t) for i, t, _ in rows}
    full = [g for g in grams.values() if g]
    df = Counter(b for g in full for b in g)
    langs = sorted({x for _, _, x in rows})

    def vector(g):
        v = {b: (1 + math.log(c)) * (math.log((1 + len(full)) / (1 + df[b])) + 1) for b, c in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    def draw(i):
        h = xxhash.xxh64_intdigest("draw", xxhash.xxh64_intdigest(str(i), 42))
        return h - (1 << 64) if h >> 63 else h
    order = sorted((draw(i), langs.index(x), i) for i, _, x in rows if grams[i])
    z, n = {}, {}

    def weight(k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        if abs(a) <= CFG.l1:
            return 0.0
        return (math.copysign(CFG.l1, a) - a) / ((CFG.beta + math.sqrt(b)) / CFG.alpha + CFG.l2)

    def logits(v):
        return [sum(x * weight((b, k)) for b, x in v.items()) for k in range(len(langs))]
    for _ in range(CFG.epochs):
        for d, y, i in order:
            if d // (1 << 30) % CFG.calibration == 0:
                continue
            v = vector(grams[i])
            p = slow_softmax(logits(v))
            old = {(b, k): weight((b, k)) for b in v for k in range(len(langs))}
            for (b, k), w in old.items():
                g = v[b] * (p[k] - (k == y))
                was = n.get((b, k), 0.0)
                n[b, k] = was + g * g
                z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(n[b, k]) - math.sqrt(was)) / CFG.alpha * w
    held = [(logits(vector(grams[i])), y) for d, y, i in order if d // (1 << 30) % CFG.calibration == 0]
    rest = 1 / (len(held) + 2)

    def loss(t):
        return -sum((1 - rest if k == y else rest / (len(langs) - 1)) * math.log(p)
                    for q, y in held for k, p in enumerate(slow_softmax([x / t for x in q])))
    at = min(np.linspace(-4, 3, 2001), key=lambda u: loss(math.exp(u)))       # on a grid
    out = {}
    for i, g in grams.items():
        if not g:
            out[i] = (langid.UNKNOWN, 0.0)
            continue
        p = slow_softmax([x / math.exp(at) for x in logits(vector(g))])
        out[i] = (langs[p.index(max(p))], max(p))
    return out


def test_language_brute_force(spark, make_docs):
    rows = documents()
    docs = make_docs(rows)
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"), CFG)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id"], cfg=CFG).collect()}
    want = slow_model(rows)
    assert len(got) == len(want) and any(x != langid.UNKNOWN for x, _ in want.values())
    for i, (lang, score) in want.items():
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=0.005)


def test_many_dirty_languages(spark, make_docs):
    """Thousands of values: the most frequent ones are learned."""
    rows = documents() + [(5000 + i, f"junk {i}", f"z{i:05}") for i in range(3000)]
    docs = make_docs(rows)
    cfg = langid.Fit(bits=9, max_n=2, max_langs=4)
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"), cfg)
    assert model.langs == ["aa", "bb", "cc", "z00000"] and model.weights.shape == (512, 4)
    assert {r["lang_pred"] for r in langid.predict(docs, model, ["doc_id"], cfg=cfg).collect()} <= {
        *model.langs, langid.UNKNOWN}


@pytest.mark.parametrize("hot_rows", [1, 5, 1000])
def test_members_of_large_components(spark, hot_rows):
    rows = [(i, 1000 + i, i % 3) for i in range(60)] + [(100, 7, 100), (101, None, 100), (102, None, 102)]
    rows = [(fp, least, {0: 0, 1: 1, 2: 2}.get(root, root)) for fp, least, root in rows]
    named = spark.createDataFrame(rows, "fp bigint, least bigint, root bigint")
    got = {r["f"]: (r["component_id"], r["root"]) for r in simhash._named_components(named, hot_rows).collect()}
    want = {}
    for fp, least, root in rows:
        ids = [x for _, x, r in rows if r == root and x is not None]
        want[fp] = (min(ids) if ids else None, root)
    assert got == want
