"""Operators against brute force, the public tokenizer library and DuckDB."""

import math
import random
import re
import string
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from carepulse.llm import decontaminate, gru, langid, licenses, lm, pieces, quality, queries, secret_scan, simhash
from conftest import SF001
from llm_helpers import make_docs  # noqa: F401
from oracle_compare import canon, duck

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    con = duck(SF001)
    return con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    a = queries.QUERIES[name](spark, SF001).toPandas()
    b = duck(SF001).execute(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)


# -- quality ---------------------------------------------------------------

def test_repeated_words_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randint(0, rng.choice([1, 3, 40])) for _ in range(rng.randint(0, 40))]
        grams = Counter(tuple(ids[i:i + 8]) for i in range(len(ids) - 7))
        covered = {j for i in range(len(ids) - 7) if grams[tuple(ids[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(np.array(ids, np.int64)) == len(covered)


def test_flagged_host_is_held_to_strict_limits(spark, make_docs):
    clean = "every word of this text is different from all others so that no rule has anything to say about it here"
    border = clean + " #1 #2"                    # few symbols: fails only strict limits
    junk = "*** " * 40
    rows = [(i, junk, "en", "bad") for i in range(60)] + [(100, clean, "en", "bad"), (101, border, "en", "bad")]
    rows += [(200 + i, clean + f" {i}", "en", "good") for i in range(60)] + [(300, border, "en", "good")]
    got = {r["doc_id"]: r for r in quality.quality_rules(make_docs(rows)).collect()}
    assert got[0]["host_flagged"] and not got[200]["host_flagged"]
    assert got[100]["kept"] and got[300]["kept"] and not got[101]["kept"] and not got[0]["kept"]
    kept = {r["doc_id"] for r in quality.keep_good(make_docs(rows)).collect()}
    assert kept == {k for k, r in got.items() if r["kept"]}


# -- near duplicates -------------------------------------------------------

def slow_fingerprint(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids, max_bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= max_bits):
            parent[find(i + 1 + int(j))] = find(i)
    root = [find(i) for i in range(len(f))]
    least = {}
    for r, i in zip(root, ids):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


def test_fingerprints(corpus):
    for _, text, _, _ in corpus[:60]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(b"") == 0 == slow_fingerprint(" \n")
    assert simhash.fingerprint("É A b".encode()) == slow_fingerprint("É A b")


def planted_fingerprints(n=400):
    """Unrelated values, chains, and one dense ball around a centre."""
    rng = random.Random(5)
    out = [rng.getrandbits(64) for _ in range(n)]
    for i in range(40):
        x = out[i]
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            out.append(x)
    for _ in range(300):
        x = out[0]
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("blocks,bucket_rows", [(6, 20_000), (7, 20_000), (5, 30), (6, 25)])
def test_links_connect_what_brute_force_connects(spark, blocks, bucket_rows):
    fps = planted_fingerprints()
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    links = simhash.links(df, 4, blocks, bucket_rows)
    pairs = links.collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 or True for a, b in pairs)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = [root.get(x, x) for x in signed]
    assert got == slow_components(fps, signed)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 2000), (2000, 1500)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert all(root[i] == 0 for i in range(201))
    assert {root[i] for i in (1000, 1500, 2000)} == {1000}


def test_near_duplicates_and_keep_one(spark, make_docs, corpus):
    rows = [(i, t) for i, t, _, _ in corpus] + [(-5, None), (9001, ""), (9001, ""), (None, "no id here at all")]
    docs = make_docs(rows)
    got = simhash.near_duplicates(docs).collect()
    known = [(i, slow_fingerprint(t)) for i, t in rows if i is not None]
    want = dict(zip([i for i, _ in known], slow_components([f for _, f in known], [i for i, _ in known])))
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values()))
    assert kept.count(None) == 1


def test_keep_one_with_an_id_of_two_texts(spark, make_docs):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = make_docs([(1, a), (2, a), (2, b), (3, b), (4, a), (4, "some other words"), (4, "some other words")])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == [
        (1, a), (2, b), (4, "some other words")]


# -- decontamination -------------------------------------------------------

def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(1, 14))]
        assert decontaminate.align(np.array(a), np.array(b)) == slow_align(a, b)


def test_leaks_exact_edited_and_common(spark, make_docs, corpus, monkeypatch):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rng = random.Random(4)

    def edit(text):
        w = text.split()
        for k in range(4, len(w), 7):            # every seventh word changed, one left out
            w[k] = "qqq"
        return " ".join(w[:9] + w[10:])
    plain = {i: t for i, t, _, _ in corpus if not any(
        b" ".join(decontaminate.words_of(x)) in b" ".join(decontaminate.words_of(t)) for x in items.values())}
    rows = [(i, t) for i, t in list(plain.items())[:80]]
    planted = {}
    for k, (i, text) in enumerate(items.items()):
        host = rng.choice(rows[:80])[1].split()
        copy = text if k % 2 else edit(text)
        rows.append((10_000 + k, " ".join(host[:50] + copy.split() + host[50:])))
        planted[10_000 + k] = i
    common = items[0]
    rows += [(20_000 + k, f"row {k} " + common) for k in range(60)]     # in a third of the rows
    for block_words in (200_000, 100):            # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]]
               for r in decontaminate.find_leaks(make_docs(rows), bench, ["doc_id"]).collect()}
        assert all(planted[k] in got[k] for k in planted)
        assert all(0 in got[20_000 + k] for k in range(60))
        assert not any(got[i] for i, _ in rows[:80])


# -- secrets ---------------------------------------------------------------

def slow_base(x):
    kinds = secret_scan.KINDS
    out = [("assign", *m.span()) for m in re.finditer(
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])"""
        r"""|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        x) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def test_base_spans_brute_force(corpus):
    rng = random.Random(3)
    parts = ["password", "PassWd", "toKen", "api_key", "APIKEY", "ſecret", "toKen", "secret", '"', "'", " ", ":",
             "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "deadbeef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t in texts + [t for _, t, _, _ in corpus]:
        assert secret_scan.base_spans(t) == slow_base(t)


def test_novel_strings():
    hit = "use the bearer eyJhbGciOiJIUzI1NiJ9kQ3xZ81kQpLm now"
    (kind, a, b), = secret_scan.find_secrets(hit)
    assert kind == "novel" and hit[a:b] == "eyJhbGciOiJIUzI1NiJ9kQ3xZ81kQpLm"
    assert secret_scan.find_secrets("nothing here eyJhbGciOiJIUzI1NiJ9kQ3xZ81kQpLm") == []
    assert secret_scan.find_secrets("the authorization of development_settings_2024 in config") == []
    assert secret_scan.find_secrets("access key example0123456789abcdefghijklmnop") == []
    assert secret_scan.redact("a password=abcdef99 b", secret_scan.find_secrets("a password=abcdef99 b")) == "a [SECRET] b"


def random_string(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_copies_do_not_hide_a_secret():
    rng = random.Random(4)
    for gap in (0, 5, 990, 1000, 1024):
        key = random_string(rng, string.ascii_letters + string.digits, 30) + "7k"
        line = f"the bearer {key} \n"
        text = line + "word " * (gap // 5) + line
        assert [text[a:b] for _, a, b in secret_scan.find_secrets(text)] == [key, key]
        assert key not in secret_scan.redact(text, secret_scan.find_secrets(text))


@pytest.mark.parametrize("alphabet,n,least", [
    (string.ascii_lowercase, 24, 38), (string.ascii_letters, 24, 39), (string.digits, 24, 40),
    ("0123456789ABCDEF", 96, 40), ("0123456789ABCDEF", 128, 40), ("0123456789ABCDEF", 256, 40)])
def test_random_strings_of_any_alphabet(alphabet, n, least):
    rng = random.Random(5)
    found = 0
    for _ in range(40):
        key = random_string(rng, alphabet, n)
        text = f"the bearer {key} is sent with the request"
        found += [text[a:b] for _, a, b in secret_scan.find_secrets(text)] == [key]
    assert found >= least


def test_punctuated_secrets_and_plain_words():
    text = "the passphrase (hT7!vq#Zp2&mX9$kLw) opens it"
    assert [text[a:b] for _, a, b in secret_scan.find_secrets(text)] == ["hT7!vq#Zp2&mX9$kLw"]
    for plain in ("authentication characteristics", "token internationalization", "secret getUserAccountSettings()",
                  "credential http://example.com/account/settings", "token on 2024-01-15/2024-02-20"):
        assert secret_scan.find_secrets(plain) == []


# -- pieces ----------------------------------------------------------------

@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public vocabulary as a unigram model, with finite scores for runs of
    blanks (the file's -1e9 leaves the library's 32-bit sums no digits)."""
    import sentencepiece
    raw = open(pieces.MODEL, "rb").read()
    i = raw.index(b"\x12\x06tok_v0\x18\x02")
    raw = raw[:i + 9] + b"\x01" + raw[i + 10:]
    raw = raw.replace(struct.pack("<f", -1e9), struct.pack("<f", -40000.0))
    path = str(tmp_path_factory.mktemp("m") / "unigram.model")
    open(path, "wb").write(raw)
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(unigram, corpus):
    path, sp = unigram
    v = pieces.Vocabulary(path)
    rng = random.Random(1)
    parts = ["the", " ", "a", "b", "ing", "tion", "  ", "é", "x", "ZQ", "1", ".", "ß", "\n", "日本", "\U0001F600", "Ж", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for t in texts + [t for _, t, _, _ in corpus]:
        ids = [x for s in v.split(t) for x in v.encode_segment(s)]
        assert ids == sp.encode(t)
        assert v.decode(ids) == t
        assert sum(v.count_segment(s)[0] for s in v.split(t)) == len(ids)


def test_ties_keep_the_longest_last_piece():
    v = pieces.Vocabulary.__new__(pieces.Vocabulary)
    import ahocorasick
    v.automaton, v.singles, v.unknown, v.byte_ids = ahocorasick.Automaton(), set("▁ab"), -99.0, list(range(256))
    for i, (p, s) in enumerate([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]):
        v.automaton.add_word(p, (len(p), s, 300 + i))
    v.automaton.make_automaton()
    assert v.encode_segment(" ab") == [300, 303]          # of three equal paths
    assert v.count_segment(" ab") == (2, -3.0)


def test_round_trip_of_any_text(spark, make_docs):
    texts = ["", " ", "▁", " ▁ ▁", "a\nb\r\n\tc", "\x00\U0001F600é", "  lead and trail  "]
    out = pieces.decode_pieces(pieces.encode_pieces(make_docs(list(enumerate(texts))))).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == dict(enumerate(texts))


# -- licences --------------------------------------------------------------

def test_license_bounds_lose_nothing():
    known = licenses.Templates()
    rng = random.Random(1)
    hits = 0
    for _ in range(1500):
        w = licenses.words_of(rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.randint(0, len(w) // 4 + 1)):
            k = rng.randrange(len(w)) if w else 0
            w[k:k + rng.randint(0, 1)] = rng.choice([[], ["the"], ["zz"]])
        grams, best = licenses.bigrams(w), {}
        for size, name, g in known.sets:
            d = 2 * len(grams & g) / (len(grams) + size)
            if d >= known.threshold:
                best[name] = max(d, best.get(name, 0))
        want = sorted((k, d) for k, d in best.items() if d == max(best.values()))
        assert (known.match(grams) if not known.anchors.isdisjoint(w) else []) == want
        hits += bool(want)
    assert hits > 500


def test_license_lines(spark, make_docs):
    mit = licenses.TEMPLATES[4][1]
    text = "Some text.\nReleased under the MIT license\nmore\n\n" + mit.upper().replace(". ", ".\n") + "\n\nend"
    hits = licenses.scan_licenses(make_docs([(1, text), (2, "no notice")])).collect()
    got = {r["doc_id"]: [(h["license"], text[h["start"]:h["end"]][:12]) for h in r["hits"]] for r in hits}
    assert got == {1: [("MIT", "Released und"), ("MIT", "PERMISSION I")], 2: []}


@pytest.mark.parametrize("name,k", [("MIT", 4), ("BSD-2-Clause", -2), ("BSD-3-Clause", -1), ("ISC", -3)])
def test_licenses_across_lines_and_paragraphs(name, k):
    known, wording = licenses.Templates(), licenses.TEMPLATES[k]
    assert wording[0] == name
    body, other = wording[1], " ".join(f"word{i}" for i in range(150))
    wrapped = re.sub(r"((?:\S+ ){9})", r"\1\n", body)
    for mid in (body.replace(". ", ".\n\n"), wrapped, body):
        for text in (f"{other}\n\n{mid}\n\n{other}", f"{other} {mid} {other}"):
            hit, = known.scan(text)
            assert hit[2] == name and hit[3] > 0.95
            assert licenses.words_of(text[hit[0]:hit[1]]) == licenses.words_of(body)
    (a, b, n, d), = known.scan(text := f"{other} released under the\nMIT License {other}")
    assert (n, d, text[a:b]) == ("MIT", 1.0, "released under the\nMIT License")


# -- languages -------------------------------------------------------------

def test_language_held_out_accuracy(spark, corpus):
    out = queries.QUERIES["op2_language_id"](spark, SF001).collect()
    lang = {i: x for i, _, x, _ in corpus}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(corpus)
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_undetermined(spark, make_docs):
    model = langid.Model(["en"], np.ones(1 << 15), np.zeros((1 << 15, 1)), 1.0)
    rows = [(1, None), (2, "12 345 !?"), (3, "word")]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(make_docs(rows), model, ["doc_id"]).collect()}
    assert out == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("en", 1.0)}


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert abs(langid.temperature(5 * z, y) - 5) < 0.6


# -- language model --------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    g = gru.Gru(40, 6)
    g = gru.Gru(40, 6, flat=rng.standard_normal(g.flat.size) * 0.3)
    tok, lens = rng.integers(0, 42, 60), np.array([20, 5, 1, 14, 20])
    i, t, d, f, a = gru.sheet(tok, lens, 3)

    def loss():
        s, _ = g.run(i, f, a, np.zeros((i.shape[1], 6)))
        return -g.logprob(s, t[d >= 0]).mean()
    keep, grad = {}, {}
    s, _ = g.run(i, f, a, np.zeros((i.shape[1], 6)), keep)
    g.logprob(s, t[d >= 0], grad)
    g._backward(i, f, a, keep, grad)
    rows, gx = grad.pop("x")
    grad["x"] = np.zeros_like(g.p["x"])
    grad["x"][rows] = gx
    for k, v in g.p.items():
        v = v.reshape(-1)
        for j in rng.choice(v.size, min(8, v.size), replace=False):
            old = v[j]
            v[j] = old + 1e-5
            up = loss()
            v[j] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - grad[k].reshape(-1)[j]) < 1e-6
            v[j] = old


def slow_gru(g, doc):
    n, h, before, total = g.hidden, np.zeros(g.hidden), 0, 0.0
    for w in doc:
        x, u = g.p["x"][before] + g.p["b"], h @ g.p["u"]
        z, r = (1 / (1 + np.exp(-(x[a:a + n] + u[a:a + n]))) for a in (0, n))
        c = np.tanh(x[2 * n:] + r * u[2 * n:])
        h = (1 - z) * c + z * h
        out, k = h @ g.p["c"] + g.p["cb"], int(g.class_of(np.array([w]))[0])
        total += out[k] - np.log(np.exp(out).sum())
        if k >= 2:
            o = g.p["o"][k - 2] @ h + g.p["ob"][k - 2] + g.spare[k - 2]
            total += o[(w - 2) % gru.CLASS_SIZE] - np.log(np.exp(o).sum())
        before = w
    return total / math.log(10)


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(1)
    g = gru.Gru(100, 5)
    g = gru.Gru(100, 5, flat=rng.standard_normal(g.flat.size) * 0.4)
    lens = np.array([50, 1, 7, 33, 2])
    tok = rng.integers(0, 102, lens.sum())
    docs = np.split(tok, np.cumsum(lens)[:-1])
    assert np.allclose(g.score(tok, lens, width=2, window=4), [slow_gru(g, d) for d in docs])


def test_lm_scores(spark, corpus):
    out = queries.QUERIES["op5_lm_scoring"](spark, SF001).collect()
    words = {i: WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for i, t, _, _ in corpus}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in words.items() if i not in held for w in ws)
    ends = len(words) - len(held)
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in out:
        ws = words[r["doc_id"]]
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (
            len(ws) + 1, sum(w in c for w in ws) + 1, n, r["doc_id"] in held)
        assert r["score"] < 0


def test_training_beats_the_start(spark, corpus):
    """A pattern that unigrams cannot see is learned; blocks split anywhere."""
    docs = spark.createDataFrame([(i, i % 7 == 2, "a b c d e f g " * 40) for i in range(300)],
                                 "id bigint, held boolean, text string").repartition(4)
    out = lm.lm_scores(docs, lm.Lm(words=8, hidden=8, block_tokens=5000)).where("held_out").collect()
    assert np.mean([r["score"] / r["n_tokens"] for r in out]) > 0.6 * np.mean([r["base_score"] / r["n_tokens"] for r in out])


def test_every_training_document_is_learned(spark):
    """The only training document of the only partition trains the network."""
    docs = spark.createDataFrame([(0, False, "a b c d e f g " * 12_000), (1, True, "a b c d e f g " * 40)],
                                 "id bigint, held boolean, text string").coalesce(1)
    out = lm.lm_scores(docs, lm.Lm(words=8, hidden=8)).where("held_out").collect()
    assert out[0]["score"] > 0.6 * out[0]["base_score"]


# -- pipeline --------------------------------------------------------------

def test_pipeline_brute_force(spark, corpus):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "secret_scans", "sentencepiece"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF001).collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(
        spark.read.parquet(f"{SF001}/documents.parquet")).collect()}
    left = [(i, t) for i, t, _, _ in corpus if verdict[i]]
    comp = slow_components([slow_fingerprint(t) for _, t in left], [i for i, _ in left])
    left = [(i, t) for (i, t), c in zip(left, comp) if i == c]
    items = [b" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not any(x in b" ".join(decontaminate.words_of(t)) for x in items)]
    assert sorted(got) == sorted(i for i, _ in left)
    v = pieces.vocabulary(pieces.MODEL)
    for i, t in left:
        clean = secret_scan.redact(t, secret_scan.find_secrets(t))
        assert v.decode(got[i]["ids"]) == clean and got[i]["n_chars"] == len(clean)
        assert got[i]["round_trip"] and got[i]["n_pieces"] == len(got[i]["ids"])
