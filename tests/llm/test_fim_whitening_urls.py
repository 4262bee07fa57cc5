"""Fill-in-middle, whitening and URL rules against plain brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepulse.llm import common, feast, fim, url_rules, whitening
from llm_helpers import AWKWARD, make_docs  # noqa: F401
from conftest import SF01

CLASH = ["n", "form", "output", "k", "t", "restored", "host", "path", "rule", "salt", "component", "embedding_"]


# ------------------------------------------------------------ fill in middle
def brute_fim(key, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:x], t[x:y], t[y:]
    if h4 % 100 < 20:
        return n, "spm", x, y - x, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", x, y - x, f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force(spark, make_docs):
    rng = random.Random(5)
    rows = AWKWARD + [(i, "".join(rng.choice("ab <>PSM/é\U0001F600\n") for _ in range(rng.randint(0, 60))))
                      for i in range(100, 700)]
    rows += [(900, "<P>"), (901, "x<S>y"), (902, "<<M>>"), (903, "<P<S<M"), (904, ">")]
    docs = make_docs(rows, CLASH)
    out = fim.restore(fim.fill_in_middle(docs)).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
                  for r in out), key=str)
    assert got == sorted(((i, *brute_fim(i, t)) for i, t, *_ in rows), key=str)
    assert sorted(r["restored"] for r in out) == sorted(t or "" for _, t, *_ in rows)
    forms = {r["form"] for r in out}
    assert forms == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(make_docs([]))).collect() == []


def test_rotation_exchanges_neighbouring_blocks():
    for a, mid, b in [(0, 0, 5), (0, 5, 5), (1, 3, 7), (2, 3, 9), (4, 4, 4)]:
        buf, src = bytearray(b"0123456789"), b"0123456789"
        fim.rotate(buf, a, mid, b)
        assert bytes(buf) == src[:a] + src[mid:b] + src[a:mid] + src[b:]


def test_fim_of_every_pair_of_cuts_restores():
    text = "aé<\U0001F600>S".encode()
    for x in range(len(text) + 1):
        for y in range(x, len(text) + 1):
            for spm in (False, True):
                made = bytes(fim.arrange(text, x, y, spm))
                assert fim.rebuild(made, "spm" if spm else "psm") == text
    assert fim.rebuild(b"\xff<P>", "plain") == b"\xff<P>"


def test_restore_refuses_a_taken_name(make_docs):
    with pytest.raises(ValueError):
        fim.restore(fim.fill_in_middle(make_docs([(1, "a b")])), out="n")


# ----------------------------------------------------------------- whitening
def brute_whitening(vectors, components=32):
    """(x, eigenvalues, vectors, trace) by a dense eigensolver."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = (x - np.array([v // n for v in s], dtype=object)).astype(float)
    y -= y.mean(axis=0)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = min(components, int((e > 1e-11 * e[0]).sum()) if e[0] > 0 else 0)
    return x, y, s, e[:keep], u[:, :keep], np.trace(cov)


def check_whitening(rows, out, components=32):
    n = len(rows)
    x, y, s, e, u, trace = brute_whitening([v for _, v in rows], components)
    assert len(out) == n * len(e)
    by: dict = {}
    for r in out:
        by.setdefault(r["vec_id"], []).append(r)
    signs = np.ones(len(e))
    want = y @ u / np.sqrt(e)
    for (i, _), dev, w in zip(rows, ((x * n - s) ** 2).sum(axis=1), want):
        got = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in got] == list(range(1, len(e) + 1))
        g = np.array([r["whitened"] for r in got])
        if i == rows[0][0]:
            signs = np.where(g * w < 0, -1, 1)
        assert np.allclose(g, signs * w, rtol=1e-8, atol=1e-8)
        assert {r["deviation"] for r in got} == {int(dev)} and {r["n"] for r in got} == {n}
        assert np.allclose([r["explained"] for r in got], e / trace, rtol=1e-9)
        assert all(r["identity_error"] < 1e-8 for r in got)


VECTORS = "vec_id bigint, embedding array<double>, component int, n string"


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((40, 40))
    rows = [(i, [float(c) for c in rng.standard_normal(40) @ mix]) for i in range(300)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 39 + [None]), (1003, [float("nan")] * 40),
           (1004, [float("inf")] + [0.0] * 39), (1005, [1.0, 2.0]), (1006, [1e300] * 40), (None, None)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], VECTORS).repartition(5)
    check_whitening(rows, whitening.whiten(df).collect())
    five = whitening.whiten(df, components=5).collect()
    check_whitening(rows, five, 5)


def test_whitening_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check_whitening(rows, whitening.op12_embedding_whitening(spark, SF01).collect())


def test_whitening_of_few_directions(spark):
    rows = [(i, [float(i % 3), float(i % 2), 7.0, float(i % 3)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS)
    check_whitening(rows, whitening.whiten(df).collect())
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, "x"), (2, [1.0, 2.0], 0, "x")], VECTORS)
    assert whitening.whiten(one).collect() == []                 # equal rows: no direction
    assert whitening.whiten(one.limit(0)).collect() == []
    assert whitening.whiten(one).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                             "identity_error"]


def test_deviation_is_exact_or_null():
    x = np.array([[5, 7], [1, 2]])
    assert whitening.deviations(x, 3, np.array([1, 2], dtype=object)) == [14**2 + 19**2, 2**2 + 4**2]
    assert whitening.deviations(x, 2**31, np.array([0, 0], dtype=object)) == [None, 5 * 2**62 if 5 * 2**62 < 2**63 else None]
    assert whitening.deviations(np.zeros((0, 2), np.int64), 1, np.array([0, 0], dtype=object)) == []


def test_too_many_dimensions_are_refused(spark):
    wide = spark.createDataFrame([(1, [0.5] * (whitening.MAX_DIMENSIONS + 1), 0, "x")], VECTORS)
    with pytest.raises(ValueError):
        whitening.whiten(wide)


@pytest.mark.parametrize("values", [
    [5.0, 4, 3, 2, 1, 0], [3.0] * 12 + [1, 1, 0, 0], [1.0, 1e-9, 1e-9, 0], [1.0] * 20,
    list(1 + 1e-10 * np.arange(30)), list(np.geomspace(1, 1e-8, 25)), [7.0]])
def test_feast_equals_a_dense_solver(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    want = np.array([v for v in sorted(values, reverse=True) if v > 1e-11 * max(values)])[:8]
    e, x = feast.greatest(a, 8)
    assert len(e) >= len(want[:8]) and np.allclose(e[:len(want)], want, rtol=1e-6, atol=1e-14)
    assert np.allclose(a @ x, x * e, atol=1e-12 * max(values))
    assert np.allclose(x.T @ x, np.eye(len(e)), atol=1e-12)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in (*(e[:-1] + e[1:]) / 2, e[0] - 1, e[-1] + 1):
            assert feast.below(a, shift) == (e < shift).sum()
    assert feast.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


# ----------------------------------------------------------------- URL rules
def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = rest
    for mark in "/?#":
        raw = raw.split(mark, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = rest[len(raw):].split("?", 1)[0].split("#", 1)[0]
    fits = [(len(h.lower() + p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules
            if h and host and ("." + host).endswith("." + h.lower()) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("Spam.example.com", "", "block"), ("a.b", "/x", "block"),
         ("a.b", "/x/yy", "allow"), ("b", "/x/y", "block"), ("a.b", "/x/yy", "block")]
URLS = [None, "", "no scheme", "http://", "https:///path", "http://example.net", "http://example.net/",
        "http://EXAMPLE.net/en/x?y#z", "http://example.net?/en/", "http://example.net#://net/", "x://org/fr/",
        "http://fr.org/fr", "http://a.b.example.com/de/1", "http://notexample.com/de/1", "http://net./", "http://.net/",
        "http://..net//", "http://a..net/a", "http://a.b/x", "http://a.b/x/y", "http://a.b/x/yy/z", "http://c.a.b/x/yyy",
        "http://b/x/y", "http://b/x/Y", "http://spam.example.com", "http://averylonglabelnet/", "http://u@a.net:80/",
        "http://u@a.net/", "a://b://net/", "http://n\u00c4\u0130.net/\u00e9/", "http://net/\n/x", "http:// net/ "]


def random_urls(n):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "net", "example", "com", "org", "x", "yy", "EN", "en", "fr", "de", ""])
    return ["http://" + ".".join(part() for _ in range(rng.randint(1, 4)))
            + "".join("/" + part() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?q=/", "#f"])
            for _ in range(n)]


@pytest.mark.parametrize("rules", [RULES, RULES[:4], []])
@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_equal_brute_force(spark, monkeypatch, rules, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    urls = URLS + random_urls(400) + ["http://hot.example.net/en/1"] * 50 + ["http://x.net/" + "/a.b" * 200_000]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h") for i, u in enumerate(urls)],
                                  "page_id bigint, url string, html string")
    for name in CLASH:
        pages = pages.withColumn(name, F.lit("x"))
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block"), ("net", None, None),
                                           ("net", "/", "maybe")], "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, table).collect()
    want = [(i if i % 9 else None, *brute_url(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_short_prefixes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SHORT", 1)
    urls = random_urls(200)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_rules.judge_urls(pages, table).collect()))
    assert got == sorted((i, *brute_url(u, RULES)) for i, u in enumerate(urls))


def test_urls_of_an_empty_table_and_no_python(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_rules.judge_urls(pages, table)
    assert out.collect() == []
    plan = url_rules.op13_url_filters(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "html" not in plan                    # only the two columns are read
