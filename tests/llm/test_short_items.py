"""Benchmark items of one word, two words, and no word at all."""

import random

from carepulse.llm import decontaminate
from llm_helpers import make_docs  # noqa: F401


def test_items_shorter_than_a_seed(spark, make_docs):
    docs = make_docs([(1, "over the hill"), (2, "blue, MOON rises"), (3, "blue and moon"), (4, "moon blue"),
                      (5, "nothing here"), (6, "thesis"), (7, None), (8, "the"), (9, "the blue moon")])
    items = spark.createDataFrame([(1, "The"), (2, "blue moon"), (3, ""), (4, None), (5, " .,; ")],
                                  "item_id bigint, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]]
           for r in decontaminate.find_leaks(docs, items, ["doc_id"]).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [], 5: [], 6: [], 7: [], 8: [1], 9: [1, 2]}


def test_a_benchmark_of_many_rounds_gives_the_same_leaks(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 30)))) for k in range(40)]
    items += [items[3], (3, items[4][1]), (None, items[5][1]), (41, None), (42, "")]       # repeated, shared ids
    rows, planted = [], {}
    for d in range(150):
        words = rng.choices(vocab, k=60)
        if d % 3 == 0:                                  # two items, of different blocks as it happens
            planted[d] = {d % 40, (d * 7 + 1) % 40}
            words[20:20] = [w for i in sorted(planted[d]) for w in items[i][1].split()]
        rows.append((d, " ".join(words)))
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000, None), (2001, "")]      # copies, blanks
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs(rows, extra=["__digest", "__key", "__salt", "__leaks"])

    def found():
        out = decontaminate.find_leaks(docs, bench, ["doc_id", "__digest"]).collect()
        assert {r["__digest"] for r in out} == {"x"}
        return sorted((r["doc_id"], [(x["item_id"], round(x["score"], 9)) for x in r["leaks"]]) for r in out)
    whole = found()
    assert len(whole) == len(rows)
    got = dict(whole)
    assert all(planted[d] <= {i for i, _ in got[d]} for d in planted)
    assert all(got[1000 + k] == got[0] for k in range(300)) and got[2000] == got[2001] == []
    clean = sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect())
    assert clean == sorted(d for d, hits in whole if not hits)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontaminate, "LIVE_BLOCKS", 3)
    assert decontaminate.benchmark_items(bench, "item_id", "text")[1] > 2 * 3
    assert found() == whole                             # leaks of all rounds joined by broadcast
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found() == whole                             # and salted
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == clean
