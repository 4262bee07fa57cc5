"""Every operator over awkward rows, an empty table and clashing columns."""

import pytest
from pyspark.sql import functions as F

from carepulse.llm import chat, decontaminate, langid, licenses, lm, pieces, quality, secret_scan, simhash
from llm_helpers import AWKWARD, make_docs  # noqa: F401

CLASH = ["ids", "score", "leaks", "spans", "kept", "id", "fp", "block", "hits", "key", "__x", "count"]


def operators(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "")],
                                  "item_id bigint, text string")
    return {
        "decontaminate": lambda d: decontaminate.find_leaks(d, bench, ["doc_id"]),
        "drop_leaks": lambda d: decontaminate.drop_leaks(d, bench),
        "langid": lambda d: langid.predict(d, langid.fit(d.where("lang is not null").select(
            F.col("doc_id").alias("key"), "text", "lang")), ["doc_id"]),
        "tokens": pieces.count_tokens,
        "quality": quality.quality_rules,
        "keep_good": quality.keep_good,
        "lm": lambda d: lm.lm_scores(d.select(F.col("doc_id").alias("id"), F.lit(False).alias("held"), "text")),
        "simhash": simhash.near_duplicates,
        "keep_one": simhash.keep_one,
        "pieces": lambda d: pieces.decode_pieces(pieces.encode_pieces(d)),
        "licenses": licenses.scan_licenses,
        "secrets": secret_scan.scan_secrets,
        "redact": secret_scan.redact_secrets,
    }


NAMES = ["decontaminate", "drop_leaks", "langid", "tokens", "quality", "keep_good", "lm", "simhash",
         "keep_one", "pieces", "licenses", "secrets", "redact"]
FILTERS = {"drop_leaks", "keep_good", "keep_one"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, make_docs, name):
    docs = make_docs(AWKWARD, CLASH)
    out = operators(spark)[name](docs).collect()
    if name in FILTERS:
        assert len(out) < len(AWKWARD)
    else:
        assert len(out) == len(AWKWARD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, make_docs, name):
    assert operators(spark)[name](make_docs([])).collect() == []


def test_chats_awkward(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", None), (1, 1, None, "x"), (None, None, None, None), (2, None, "user", "b"),
         (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", ""), (4, 0, "a|>\\<|end|>\n", "<|more|>\\")],
        "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(rows)
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert len(got) == 5
    turns = {k: [(m["role"], list(m["texts"])) for m in r["turns"]] for k, r in got.items()}
    assert turns[1] == [("user", [""]), ("", ["x"])]
    assert turns[None] == [("", [""])]
    assert turns[2] == [("user", ["b", "a", "a"])]
    assert turns[4] == [("a|>\\<|end|>\n", ["<|more|>\\"])]
    assert [(s["start"], s["end"]) for s in got[3]["loss_spans"]] == [(19, 19)]
    assert chat.format_chats(rows.limit(0)).collect() == []


#: Names that the stages use, or used, for columns of their own.
WORKING = ["__host", "__flagged", "__n_words", "__text", "__src", "__kept", "__leaks", "__found", "__gone", "__odd",
           "__fp", "__decoded", "decoded", "n_pieces", "round_trip", "ids", "h", "row", "id", "fp", "spans", "_found"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_return_columns_of_any_name(spark, make_docs, stage):
    import corpus_pipeline
    from conftest import SF01
    name, call = corpus_pipeline.STAGES[stage]
    texts = [" ".join(f"w{i}of{j}" for j in range(40)) for i in range(4)]
    rows = [*AWKWARD, *((100 + i, t, "en", "good") for i, t in enumerate(texts))]
    docs = make_docs(rows)
    plain = call(spark, docs, SF01)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in WORKING})
    out = call(spark, docs, SF01)
    got = out.collect()
    assert len(got) == plain.count() and got
    for r in got:
        for c in WORKING:
            shown = f"doc_{c}" if name == "sentencepiece" and c in ("ids", "n_pieces", "round_trip") else c
            assert r[shown] == (None if r["doc_id"] is None else f"{c}:{r['doc_id']}"), (name, c)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    assert call(spark, docs.limit(0), SF01).collect() == []


def test_secrets_in_text_without_blanks_take_linear_time():
    import random
    import time
    rng = random.Random(1)
    key = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=20))
    many = "".join(f"auth({key()});" for _ in range(1000))
    assert len(secret_scan.find_secrets(many)) > 950
    for unit in ("token:ab;", "auth(x1);", "session_key;"):
        times = []
        for size in (200_000, 400_000):
            text = unit * (size // len(unit))
            start = time.process_time()
            secret_scan.find_secrets(text)
            times.append(time.process_time() - start)
        assert times[1] < 20 and times[1] < 4 * times[0] + 1, (unit, times)


def test_a_sensitive_word_on_either_side_counts():
    key = "kQ3xZ81kQpLm9vB2tR7yW5"
    for text in (f"{key}  # the private key", f"session_key = {' ' * 60}{key}", f"auth({key});x()",
                 f"x=1;auth={key}", f"credential:\n\n{key}", f"{key}{' ' * 300}\n<- api key"):
        spans = secret_scan.find_secrets(text)
        assert [text[a:b] for _, a, b in spans] == [key], text
    assert secret_scan.find_secrets(f"{key} " + "word " * 30 + "token") == []
