"""Secret scans: base patterns, and zstandard novelty for what they miss.

The words around sensitive words are counted over all documents; the most
frequent ones, at most ``Novelty.dictionary``, are the corpus's identifiers.  A
candidate near a sensitive word, before or behind it, is compressed together with
the code around it, primed with these identifiers and that context; the bytes it
adds (its marginal size) tell random strings from names and words."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, batch, map_batches, table

# The base patterns, in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
#: One of these is in the lower-cased text of any match: a cheap first test.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")     # the maximal runs of 24 or more

_HEX_MARKS = bytes(ord("x") if b in b"0123456789abcdef" else 32 for b in range(256))

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: The same with punctuation: printable ASCII but quotes and angle brackets.
WIDE = re.compile(r"[!#-&(-;=?-_a-~]{12,}")
_ASSIGNED = re.compile(r"""[\w-]*["']?\s*[:=]""", re.ASCII)
_NAME = re.compile(r"[\w.-]*[:=]+", re.ASCII)          # what a value may be assigned to
_ALPHABETS = tuple(re.compile(f"[{x}]+") for x in (
    "0-9", "0-9a-f", "0-9A-F", "a-z", "A-Z", "a-z0-9", "A-Z0-9", "A-Za-z", "A-Za-z0-9", "A-Za-z0-9+/_=-"))
SENSITIVE = re.compile(
    r"passw|passphrase|pwd|secret|token|api[_ -]?key|apikey|credential|auth|bearer|private[_ -]?key"
    r"|access[_ -]?key|session[_ -]?key|client[_ -]?key|encryption[_ -]?key|signing[_ -]?key|signature",
    re.ASCII | re.IGNORECASE)
SENSITIVE_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "auth",
                   "bearer", "private", "access", "session", "client", "encryption", "signing",
                   "signature")

#: Identifiers and words of configuration and code that prime the compressor
#: beside those learned from the corpus.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id "
    "client_secret authorization bearer credentials username user email account session cookie "
    "config settings environment production development staging default value string number "
    "boolean object array function return import export const let var public private static "
    "class interface package module require include define https http localhost com org net "
    "json xml yaml html utf-8 base64 content-type application connection database host port "
    "server client request response header timeout version true false null none undefined "
    "getElementById addEventListener setTimeout createElement toString hashCode equals length "
    "first second third before after because through without example placeholder changeme "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "AAAAAAAAAAAA xxxxxxxxxxxx XXXXXXXXXXXX ____________ ------------ ============ 000000000000")


@dataclass(frozen=True)
class Novelty:
    near: int = 48              # characters, blanks aside, between a candidate and a sensitive word
    context: int = 1024         # code points around it that the compressor knows
    min_ratio: float = 0.7      # marginal bytes per byte, or per byte that a random string adds
    max_known: float = 0.7      # share of known pairs of characters from which a string is words
    min_strange: float = 0.8    # bytes added, as a share of what random strings of its alphabet add
    dictionary: int = 4096      # identifiers learned from the corpus
    min_texts: int = 2          # texts in which an identifier stands
    level: int = 3


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "replace").translate(_HEX_MARKS):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Identifiers:
    """What the compressor knows before it sees a text: ``learned`` words, most
    frequent first, and the fixed ones.

    ``content`` holds the words themselves.  ``trained`` is a zstandard dictionary
    trained on them, which also brings their letters' code lengths, and ``leads``
    are texts of their letters, long enough that zstandard codes literals behind
    them; so even the size of a short string depends on how likely its letters are."""

    LEADS, DICTIONARY_BYTES = 4, 16_384

    def __init__(self, learned: tuple[str, ...] = ()):
        words = [*IDENTIFIERS.split(), *learned]
        self.content = " ".join([*reversed(learned), IDENTIFIERS]).encode()
        size = min(self.DICTIONARY_BYTES, max(1024, len(self.content) // 2))
        lines = [" ".join(words[i:i + 8]).encode() for i in range(0, len(words), 8)]
        lines *= -(-10 * size // sum(map(len, lines)))
        self.trained = zstandard.train_dictionary(size, lines, k=64, d=8, level=12).as_bytes()
        letters, rng = Counter("".join(words)), random.Random(0)
        pool = sorted(letters)
        self.leads = ["".join(rng.choices(pool, [letters[x] for x in pool], k=200 + 7 * i)).encode()
                      for i in range(self.LEADS)]
        self.runs = {d[i:i + 12] for d in (self.content, self.trained) for i in range(len(d) - 11)}

    def without(self, word: bytes) -> tuple[bytes, bytes]:
        """Content and trained dictionary with blanks for what they share with
        ``word`` in runs of 12: a key that was learned does not hide itself."""
        both = self.content, self.trained
        if any(word[i:i + 12] in self.runs for i in range(len(word) - 11)):
            both = tuple(without_copies(d.decode("latin-1"), word.decode("latin-1")).encode("latin-1") for d in both)
        return both


@lru_cache(1)
def fixed_identifiers() -> Identifiers:
    return Identifiers()


def marginal_bytes(candidate: bytes, around: bytes, content: bytes, level: int = 3) -> int:
    """Bytes that ``candidate`` adds to a frame that holds a short lead, given
    the identifiers and the text around it."""
    known = zstandard.ZstdCompressionDict(content + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False)
    lead = around[-16:]
    return len(z.compress(lead + candidate)) - len(z.compress(lead))


def strangeness(word: str, around: bytes, trained: bytes, leads: list[bytes]) -> float:
    """Bytes that ``word`` adds behind the leads, given the trained dictionary and
    the text around it, by the mean of what random strings of its length and
    alphabet add: about 1 for a random string, less for words."""
    known = zstandard.ZstdCompressionDict(trained + b"\n" + around, dict_type=zstandard.DICT_TYPE_FULLDICT)
    z = zstandard.ZstdCompressor(level=12, dict_data=known, write_content_size=False)
    bare = sum(len(z.compress(x)) for x in leads)

    def added(x: bytes) -> int:
        return sum(len(z.compress(lead + x)) for lead in leads) - bare
    like = [added(random_like(word, k)) for k in range(4)]
    return added(word.encode()) * len(like) / max(1, sum(like))


def without_copies(text: str, word: str, least: int = 12) -> str:
    """``text`` with blanks for all it shares with ``word`` in runs of ``least``
    characters: a copy nearby says nothing about how random a string is."""
    runs = {word[i:i + least] for i in range(len(word) - least + 1)}
    out, done = [], 0
    for i in range(len(text) - least + 1):
        if text[i:i + least] in runs:
            at = max(done, i)
            out += [text[done:at], " " * (i + least - at)]
            done = i + least
    return "".join([*out, text[done:]])


def context_of(text: str, a: int, b: int, size: int) -> str:
    """``size`` code points on each side of ``text[a:b]``, without its copies;
    copies that the edge of the context cuts are blanked whole."""
    word, more = text[a:b], size + b - a
    left = without_copies(text[max(0, a - more):a], word)
    return left[-size:] + without_copies(text[b:b + more], word)[:size]


def random_like(word: str, which: int = 0) -> bytes:
    """A random string of the length and alphabet of ``word``, by rule."""
    for x in _ALPHABETS:
        if x.fullmatch(word):
            chars = [c for c in map(chr, range(33, 127)) if x.fullmatch(c)]
            break
    else:
        chars = list(map(chr, range(33, 127)))
    return "".join(random.Random(len(word) + (which << 32)).choices(chars, k=len(word))).encode()


def known_pairs(word: str, around: str) -> float:
    """Share of ``word``'s pairs of characters that the identifiers or the words
    around it hold (strings as long as a candidate are not taken for words)."""
    words = CANDIDATE.sub(" ", around).lower()
    low, known = word.lower(), _identifier_pairs() | set(zip(words, words[1:]))
    return sum(x in known for x in zip(low, low[1:])) / (len(low) - 1)


@lru_cache(1)
def _identifier_pairs() -> frozenset:
    words = IDENTIFIERS[:IDENTIFIERS.index(" abcdefgh")].lower()      # without the alphabets
    return frozenset(zip(words, words[1:]))


def is_novel(text: str, a: int, b: int, cfg: Novelty, known: Identifiers) -> bool:
    """Is ``text[a:b]`` incompressible?  Bytes of strings with letters and digits
    count as they are.  Zstandard stores short unknown words as they are and
    codes the letters of long strings, so the others, and what stays under the
    flat bound, are held against random strings, and words by their pairs too."""
    word = text[a:b]
    around = context_of(text, a, b, cfg.context)
    content, trained = known.without(word.encode())
    size = marginal_bytes(word.encode(), around.encode(), content, cfg.level)
    digits = any(c.isdigit() for c in word)
    mixed = CANDIDATE.fullmatch(word) and digits and (
        any(c.islower() for c in word) + any(c.isupper() for c in word) > 0)
    if mixed and size >= cfg.min_ratio * len(word):
        return True
    if not word.isdigit() and not any(c.isalpha() for c in word):
        return False                                       # rules, dates, numbers with signs
    like = marginal_bytes(random_like(word), around.encode(), content, cfg.level)
    if size < cfg.min_ratio * min(len(word), like):
        return False
    if not word.isdigit() and known_pairs(word, around) >= cfg.max_known:
        return False
    return strangeness(word, around.encode(), trained, known.leads) >= cfg.min_strange


class Surroundings:
    """Where a text's sensitive words and base spans lie, for lookups by bisection."""

    def __init__(self, text: str, base: list[tuple[str, int, int]], near: int):
        hints = [m.span() for m in SENSITIVE.finditer(text)]
        self.starts, self.ends, self.reach = [a for a, _ in hints], [b for _, b in hints], near
        # a word that a value is assigned to says nothing about what stands before it
        self.labels = [a for a, b in hints if not _ASSIGNED.match(text, b)]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if hints else np.zeros(0, np.uint32)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.solid = np.concatenate(([0], np.cumsum(~blank)))     # characters before a place, blanks aside
        self.taken: list[list[int]] = []                          # base spans, overlaps joined
        for _, a, b in base:
            if self.taken and a < self.taken[-1][1]:
                self.taken[-1][1] = max(self.taken[-1][1], b)
            else:
                self.taken.append([a, b])
        self.from_ = [a for a, _ in self.taken]

    def free(self, a: int, b: int) -> bool:
        """No base span meets [a, b)."""
        i = bisect_left(self.from_, b) - 1
        return i < 0 or self.taken[i][1] <= a

    def holds(self, a: int, b: int) -> bool:
        """A sensitive word starts in [a, b)."""
        return bisect_left(self.starts, a) < bisect_left(self.starts, b)

    def sensitive(self, a: int, b: int) -> bool:
        """A sensitive word ends shortly before [a, b), or one without a value of
        its own starts shortly after it."""
        i, j = bisect_right(self.ends, a) - 1, bisect_left(self.labels, b)
        return (i >= 0 and self.solid[a] - self.solid[self.ends[i]] <= self.reach) or (
            j < len(self.labels) and self.solid[self.labels[j]] - self.solid[b] <= self.reach)


def novel_spans(text: str, base: list[tuple[str, int, int]], cfg: Novelty = Novelty(),
                known: Identifiers | None = None) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that no base span meets:
    whole runs with their punctuation, else their parts without it.  Each run and
    each part is judged once, so the time grows with the text, blanks or not."""
    low = text.lower()
    if not any(x in low for x in SENSITIVE_HINTS):
        return []
    place, known = Surroundings(text, base, cfg.near), known or fixed_identifiers()
    out: list[tuple[str, int, int]] = []
    if not place.starts:
        return out

    def secret(a: int, b: int) -> bool:
        return (b - a >= 12 and place.sensitive(a, b) and not place.holds(a, b) and place.free(a, b)
                and is_novel(text, a, b, cfg, known))
    for run in WIDE.finditer(text):
        a, b = wide_span(text, *run.span())
        if not CANDIDATE.fullmatch(text, a, b) and secret(a, b):
            out.append(("novel", a, b))
            continue
        for m in CANDIDATE.finditer(text, *run.span()):
            a, b = m.span()
            if place.holds(a, b):              # a value behind the name it is assigned to
                a = after_name(text, a, b)
            if secret(a, b):
                out.append(("novel", a, b))
    return out


def after_name(text: str, a: int, b: int) -> int:
    """Where the value starts that [a, b) assigns to a sensitive name, else ``a``."""
    name = _NAME.match(text, a, b)
    return name.end() if name and SENSITIVE.search(name[0]) else a


def wide_span(text: str, a: int, b: int) -> tuple[int, int]:
    """A run without the sensitive name it is assigned to, and without brackets
    and stops around it."""
    a = after_name(text, a, b)
    a += len(text[a:b]) - len(text[a:b].lstrip("([{,;:"))
    return a, a + len(text[a:b].rstrip(")]},;:."))


def find_secrets(text: str, cfg: Novelty = Novelty(),
                 known: Identifiers | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind; base spans first.
    ``known``: the corpus's identifiers (the fixed ones alone without)."""
    base = base_spans(text)
    order = (*KINDS, "novel")
    return sorted(base + novel_spans(text, base, cfg, known), key=lambda s: (s[1], order.index(s[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]",
           same_length: bool = False) -> str:
    """``text`` with every span (overlaps joined) replaced by ``mark``, or by as
    many marks as it has characters."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if same_length:
            out += [text[at:a], mark * (b - max(a, at))]
        elif a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_LETTERS = re.compile(r"[A-Za-z]{4,}")
_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


def context_words(text: str, cfg: Novelty = Novelty()) -> set[str]:
    """The words of 4 to 19 letters, cut at capitals, within ``cfg.context`` code
    points of the sensitive words of a text.  Base spans and strings with digits
    of a candidate's length, which may be keys, are left out."""
    low = text.lower()
    if not any(x in low for x in SENSITIVE_HINTS):
        return set()
    windows: list[list[int]] = []
    for m in SENSITIVE.finditer(text):
        a, b = max(0, m.start() - cfg.context), m.end() + cfg.context
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    if not windows:
        return set()
    shown = redact(text, [(k, a, b) for k, a, b in base_spans(text)], mark=" ", same_length=True)
    shown = CANDIDATE.sub(lambda m: " " * len(m[0]) if any(map(str.isdigit, m[0])) else m[0], shown)
    return {p for a, b in windows for w in _LETTERS.findall(shown, a, b)
            for p in _PART.findall(w) if len(p) < 20}


def learn_identifiers(docs: DataFrame, text: str = "text", cfg: Novelty = Novelty()) -> tuple[str, ...]:
    """The ``cfg.dictionary`` words that stand around sensitive words in the most
    texts of all ``docs``, most frequent first (ties by the word), of those in at
    least ``cfg.min_texts``.  Each row counts as a text; none in an empty table."""
    def start():
        def step(b: pa.RecordBatch):
            seen: Counter = Counter()
            for t in as_texts(b.column(0)):
                seen.update(context_words(t, cfg))
            return batch(pa.array(list(seen)), pa.array(list(seen.values())), names=["word", "n"]) if seen else None
        return step
    counts = map_batches(docs.select(F.col(text).alias("t")), "word string, n bigint", start) \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.min_texts)
    # as Arrow, the tasks' best words meet in a task and only the result in the driver
    best = counts.orderBy(F.desc("n"), "word").limit(cfg.dictionary).toArrow()
    return tuple(best.column("word").to_pylist())


def _shared_identifiers(docs: DataFrame, text: str, cfg: Novelty):
    """Broadcast of the identifiers learned from ``docs``: bounded by their number."""
    return docs.sparkSession.sparkContext.broadcast(Identifiers(learn_identifiers(docs, text, cfg)))


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 cfg: Novelty = Novelty()) -> DataFrame:
    """``id_col, spans`` per row; a null or empty text has no spans.  The
    identifiers are learned from all texts of ``docs`` first."""
    known = _shared_identifiers(docs, text, cfg)
    rows = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def start():
        def step(b: pa.RecordBatch):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t, cfg, known.value)]
                     for t in as_texts(b.column(1))]
            return batch(b.column(0), pa.array(found, _SPAN_ARROW), names=[id_col, "spans"])
        return step
    return map_batches(rows, f"`{id_col}` {kind}, spans {SPAN}", start)


def redact_secrets(docs: DataFrame, text: str = "text", cfg: Novelty = Novelty(),
                   mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; rows without
    secrets, null texts included, are unchanged.  The identifiers are learned from
    all texts of ``docs`` first."""
    schema, known = docs.schema, _shared_identifiers(docs, text, cfg)

    def start():
        def step(b: pa.RecordBatch):
            i = b.schema.get_field_index(text)
            col = b.column(i)
            texts = as_texts(col)
            found = [find_secrets(t, cfg, known.value) for t in texts]
            if not any(found):
                return b
            new = [redact(t, f, mark) if f else (t if ok else None)
                   for t, f, ok in zip(texts, found, col.is_valid().to_pylist())]
            return b.set_column(i, b.schema.field(i), pa.array(new, col.type))
        return step
    return map_batches(docs, schema, start)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))
