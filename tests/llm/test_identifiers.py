"""Identifiers learned from the corpus prime the compressor of the secret scan."""

import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F

from carepulse.llm import secret_scan
from llm_helpers import make_docs  # noqa: F401

SYLLABLES = [a + b for a in "bdklmnprst" for b in ("a", "ai", "o", "en", "ur", "ist")]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]


def corpus_rows(rng, vocab, n=60):
    return [(d, f"{' '.join(rng.choices(vocab, k=40))} the token of {' '.join(rng.choices(vocab, k=40))}")
            for d in range(n)]


def test_words_are_counted_by_text(spark, make_docs):
    key = "kQ3xZ81kQpLm9vB2tR7yW5"
    far = "faraway " + "pad " * 400
    rows = [(1, f"{far} the secretKey getUserName userName {key} password=hunterhunter"),
            (2, "userName userName and a credential"), (3, "userName without the sensitive kind"),
            (3, "token getSomething"), (3, "token getSomething"), (4, None), (5, ""), (None, "bearer andThis")]
    docs = make_docs(rows, extra=["word", "n", "t"])
    got = secret_scan.learn_identifiers(docs)
    texts = Counter()
    for _, t in rows:
        if t and re.search("secret|credential|token|bearer", t):
            near = t.replace(far, "").replace(key, "").replace("password=hunterhunter", "")
            near = "pad " + near if far in t else near
            texts.update({p for p in re.findall(r"[A-Z]?[a-z]{3,}", near) if 4 <= len(p) < 20 or p[0].isupper()})
    want = [w for w, n in sorted(texts.items(), key=lambda x: (-x[1], x[0])) if n >= 2 and len(w) >= 4]
    assert [w for w in got if len(w) >= 4] == want and {"Name", "user", "Something"} <= set(got)
    assert secret_scan.learn_identifiers(docs, cfg=secret_scan.Novelty(dictionary=2)) == got[:2]
    assert secret_scan.learn_identifiers(docs.limit(0)) == ()


def test_learned_words_are_not_secrets_and_random_strings_stay_so(spark, make_docs):
    rng = random.Random(2)
    vocab = words(rng, 300)
    rows = corpus_rows(rng, vocab)
    names = ["".join(rng.choices(vocab, k=3)) for _ in range(60)]
    keys = ["".join(rng.choices(string.ascii_lowercase, k=24)) for _ in range(40)]
    rows += [(1000 + k, f"the bearer {x} is sent with the request") for k, x in enumerate(names)]
    rows += [(2000 + k, f"the bearer {x} is sent with the request") for k, x in enumerate(keys)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]]
           for r in secret_scan.scan_secrets(make_docs(rows)).where("doc_id >= 1000").collect()}
    cold = sum(bool(secret_scan.find_secrets(t)) for d, t in rows if 1000 <= d < 2000)
    learned = sum(bool(got[1000 + k]) for k in range(60))
    assert learned <= 2 and learned <= cold
    assert sum(got[2000 + k] == ["novel"] for k in range(40)) >= 38


def test_a_key_that_many_texts_repeat_does_not_hide_itself(spark, make_docs):
    rng = random.Random(6)
    vocab, key = words(rng, 200), "qzjxwvkpfhqgzmcxjw"
    rows = corpus_rows(rng, vocab) + [(100 + k, f"the bearer {key} is row {k}") for k in range(50)]
    docs = make_docs(rows)
    assert key in secret_scan.learn_identifiers(docs)
    got = secret_scan.redact_secrets(docs).where("doc_id >= 100")
    assert got.where(F.col("text").contains(key)).count() == 0
    assert got.where(F.col("text").startswith("the bearer [SECRET] is row ")).count() == 50


def test_time_stays_linear_with_a_full_dictionary():
    rng = random.Random(3)
    known = secret_scan.Identifiers(tuple(dict.fromkeys(words(rng, 4096))))
    key = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=20))
    name = lambda: "".join(rng.choices(SYLLABLES, k=8))                             # noqa: E731
    for unit in (lambda: f"auth({key()});", lambda: f"auth({name()});", lambda: "token:ab;"):
        times = []
        for n in (500, 1000):
            text = "".join(unit() for _ in range(n))
            start = time.process_time()
            secret_scan.find_secrets(text, known=known)
            times.append(time.process_time() - start)
        assert times[1] < 30 and times[1] < 3 * times[0] + 1, times
