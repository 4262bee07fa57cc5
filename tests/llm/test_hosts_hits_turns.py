"""Host verdicts decide rows; licence hits and conversation turns cost linear time."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from carepulse.llm import chat, licenses, quality
from llm_helpers import make_docs  # noqa: F401

CLEAN = "every word of this text is different from all others so that no rule has anything to say about it here"
LOUD = CLEAN + " #" * 4                     # symbols: fails a rule, holds the base
BORDER = CLEAN + " #1 #2"                   # fails only the limits of a flagged host


def planted():
    rows, n = [], 0

    def add(host, *texts):
        nonlocal n
        for t in texts:
            rows.append((n, t, "en", host))
            n += 1
    add("large sound", *[f"{CLEAN} {i}" for i in range(400)], LOUD, BORDER)
    add("large bad", *[LOUD] * 300, BORDER, CLEAN, "short")
    add("large mixed", *[CLEAN] * 150, *[LOUD] * 50, BORDER)
    for k in range(25):                     # most hosts are alike, so rates shrink
        add(f"mixed {k}", *[CLEAN] * 60, *[LOUD] * 20)
    add("small bad", LOUD, BORDER, CLEAN)
    add("small sound", CLEAN, CLEAN, CLEAN)
    add(None, *[LOUD] * 300, CLEAN)
    return rows


def test_host_verdicts_decide(spark, make_docs):
    rows = planted()
    text = {i: (h, t) for i, t, _, h in rows}
    out = quality.quality_rules(make_docs(rows)).collect()
    kept = {}
    for r in out:
        kept.setdefault(text[r["doc_id"]], set()).add(r["kept"])
    flagged = {text[r["doc_id"]][0] for r in out if r["host_flagged"]}
    sound = {text[r["doc_id"]][0] for r in out if r["host_sound"]}
    assert flagged == {"large bad", None} and sound == {"large sound"}
    # one text, three verdicts
    assert kept["large sound", LOUD] == {True} and kept["large mixed", LOUD] == {False}
    assert kept["large mixed", BORDER] == {True} and kept["large bad", BORDER] == {False}
    assert kept["large bad", CLEAN] == kept[None, CLEAN] == {True}          # the appeal succeeds
    assert kept["large bad", "short"] == {False}                            # the base fails
    # three documents without a failure are too few to call a host sound
    assert kept["small bad", LOUD] == {False} and kept["small bad", BORDER] == {True}
    assert {r["doc_id"] for r in quality.keep_good(make_docs(rows)).collect()} == {
        r["doc_id"] for r in out if r["kept"]}
    ignored = quality.Rules(host_limit=2.0, sound_limit=-1.0)
    alone = {r["doc_id"]: r["kept"] for r in quality.quality_rules(make_docs(rows), rules=ignored).collect()}
    changed = {text[r["doc_id"]] for r in out if alone[r["doc_id"]] != r["kept"]}
    assert changed == {("large sound", LOUD), ("large bad", BORDER)}


def test_many_hosts_are_salted(spark, make_docs, monkeypatch):
    rows = planted()
    want = {(r["doc_id"], r["kept"]) for r in quality.quality_rules(make_docs(rows)).collect()}
    join = quality.join_counted
    monkeypatch.setattr(quality, "join_counted", lambda *a: join(*a, bound=0))
    assert {(r["doc_id"], r["kept"]) for r in quality.quality_rules(make_docs(rows)).collect()} == want


def slow_chosen(found):
    best = []
    for u in sorted(found, key=lambda u: (-u[3], -u[4], u[1] - u[0], u[0], u[2])):
        if not any(u[2] == v[2] and u[0] < v[1] and v[0] < u[1] for v in best):
            best.append(u)
    return sorted(u for u in best if not any(
        u[0] < v[1] and v[0] < u[1] and (v[4], v[3]) > (u[4], u[3]) for v in best if v[2] != u[2]))


def test_chosen_units_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        found = []
        for _ in range(rng.randint(0, 40)):
            a = rng.randint(0, 60)
            found.append((a, a + rng.randint(1, rng.choice([3, 30])), rng.choice("abc"),
                          rng.choice([0.8, 0.9, 1.0]), rng.randint(1, 4)))
        assert licenses.chosen(found) == slow_chosen(found)


def test_chosen_units_are_linear():
    def seconds(n):
        found = [(10 * i, 10 * i + 9, "abcd"[i % 4], 0.9, i % 7) for i in range(n)]
        found += [(0, 10 * n, "whole", 0.8, 9)]
        at = time.perf_counter()
        assert len(licenses.chosen(found)) == 1
        return time.perf_counter() - at
    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 0.5


def test_many_license_lines(spark, make_docs):
    """A notice that stands 4,000 times is reported 4,000 times."""
    line = "Released under the MIT license"
    hits = licenses.scan_licenses(make_docs([(1, "\n".join([line] * 4000))])).first()["hits"]
    assert [(h["start"], h["end"]) for h in hits] == [(31 * i, 31 * i + 30) for i in range(4000)]


def test_starts_of_pieces(spark):
    rng = random.Random(5)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (1, 2, 3, 4, 5, 8, 9, 255, 256, 257, 700)]
    df = spark.createDataFrame(rows, "n array<bigint>")
    for run in (1, 2, 4, 256):
        for r in df.select("n", chat.starts_of(F.col("n"), run).alias("at")).collect():
            assert r["at"] == [sum(r["n"][:i]) for i in range(len(r["n"]))]


def long_chat(spark, turns):
    text = F.concat(F.lit("é\\<|\U0001F600 "), F.repeat(F.lit("words and more "), 8), F.col("id").cast("string"))
    return spark.range(turns).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), text.alias("text"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"))


def test_long_conversation(spark):
    def read(turns):
        out = chat.format_chats(long_chat(spark, turns))
        return out.select("formatted", "loss_spans", chat.read_loss(
            F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    r = read(2000)
    texts = ["é\\<|\U0001F600 " + "words and more " * 8 + str(i) for i in range(2000) if i % 3]
    assert r["loss"] == texts
    assert [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]] == [
        t.replace("\\", "\\\\").replace("<|", "<\\|") for t in texts]
    assert hashlib.sha256("".join(r["loss"]).encode()).hexdigest() == hashlib.sha256("".join(texts).encode()).hexdigest()

    def seconds(n):
        at = time.perf_counter()
        read(n)
        return time.perf_counter() - at
    seconds(4000)
    assert seconds(16_000) < 8 * seconds(4000) + 2


@pytest.mark.parametrize("text", ["", "x", "x" * chat.CHUNK, "\U0001F600" * (chat.CHUNK + 1), "\n" * (3 * chat.CHUNK)])
def test_loss_at_chunk_borders(spark, text):
    rows = [(1, 0, "assistant", text), (1, 1, "user", text), (1, 2, "assistant", text + "\\")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert out.select(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()[0] == [text, text + "\\"]
