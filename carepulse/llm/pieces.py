"""SentencePiece encoding, decoding and token counts.

The vocabulary file gives pieces and scores; the segmentation is the unigram
one: the path of pieces with the best sum of scores.  Rules of the tokenizer:

* a blank becomes U+2581 and one is put before the text; nothing else is
  normalised; an empty text has no pieces;
* a character that no piece spells is an unknown edge with the least score
  minus 10, and is written as its UTF-8 bytes (byte fallback);
* a path replaces another only if its score is strictly better, and paths are
  offered by start from left to right: of equal paths to a position the one
  with the longest last piece stays.

Scores are summed in double precision within a segment: as no piece crosses
the border before a run of blanks, or a line feed, the best path of a text is
the chain of its segments' best paths, and equal segments are solved once.  (The
C++ library sums 32-bit floats over a whole text, so that its sums, and ties,
get coarse in long texts; where 32 bits suffice the results are the same.)  A
literal U+2581 in a text is written as bytes, so decoding gives back any text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, batch, map_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0          # fixed value
#: Solved segments kept by a task; the cache starts anew when it is full.
CACHE_SEGMENTS = 300_000


class Vocabulary:
    """Pieces of a SentencePiece model file and their automaton."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte_ids = [-1] * 256
        self.spelled: list[bytes] = []        # what an id decodes to
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        scores, inside = [], set()
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or not piece:
                self.spelled.append(b"")
                continue
            score = float(sp.get_score(i))
            scores.append(score)
            self.automaton.add_word(piece, (len(piece), score, i))
            self.spelled.append(piece.replace(BLANK, " ").encode())
            inside.update(piece)
            if len(piece) == 1:
                self.singles.add(piece)
            if re.search(f"[^{BLANK}]{BLANK}", piece):
                raise ValueError(f"piece {piece!r} crosses a blank: segments would not be separate")
        if -1 in self.byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        self.automaton.make_automaton()
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        feed = "" if "\n" in inside else "\n"
        self.segments = re.compile(f" *[^ {feed}{BLANK}]+| +|[{feed}{BLANK}]").findall

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of one segment: matches in order of their end, longest first (the
        state's own piece, then its output links), relax that end's best score."""
        if segment == BLANK:
            return [self.byte_ids[b] for b in BLANK.encode()]
        s = segment.replace(" ", BLANK)
        n = len(s)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], closed, singles, unknown = 0.0, 0, self.singles, self.unknown
        for end, (length, score, i) in self.automaton.iter(s):
            while closed < end:                      # no more pieces end there
                closed += 1
                if s[closed - 1] not in singles and best[closed - 1] + unknown > best[closed]:
                    best[closed], back[closed], piece[closed] = best[closed - 1] + unknown, closed - 1, -1
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1], piece[end + 1] = total, end + 1 - length, i
        while closed < n:
            closed += 1
            if s[closed - 1] not in singles and best[closed - 1] + unknown > best[closed]:
                best[closed], back[closed], piece[closed] = best[closed - 1] + unknown, closed - 1, -1
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[b] for b in reversed(s[back[n]:n].encode("utf-8", "replace"))]
            n = back[n]
        return out[::-1]

    def count_segment(self, segment: str) -> tuple[int, float]:
        """(pieces, score) of one segment's best path, without back pointers: the
        count travels with the best score."""
        if segment == BLANK:
            return len(BLANK.encode()), self.unknown
        s = segment.replace(" ", BLANK)
        n = len(s)
        best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], closed, singles, unknown = 0.0, 0, self.singles, self.unknown
        for end, (length, score, _) in self.automaton.iter(s):
            while closed < end:
                closed += 1
                if s[closed - 1] not in singles and best[closed - 1] + unknown > best[closed]:
                    best[closed] = best[closed - 1] + unknown
                    pieces[closed] = pieces[closed - 1] + len(s[closed - 1].encode("utf-8", "replace"))
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], pieces[end + 1] = total, pieces[end + 1 - length] + 1
        while closed < n:
            closed += 1
            if s[closed - 1] not in singles and best[closed - 1] + unknown > best[closed]:
                best[closed] = best[closed - 1] + unknown
                pieces[closed] = pieces[closed - 1] + len(s[closed - 1].encode("utf-8", "replace"))
        return pieces[n], best[n]

    def split(self, text: str) -> list[str]:
        return self.segments(" " + text) if text else []

    def decode(self, ids) -> str:
        """The text of ids; the blank put before the text is taken off."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Solved(dict):
    """Results by segment, solved when first asked for; bounded by ``trim``."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, segment):
        out = self[segment] = self.solve(segment)
        return out

    def trim(self):
        if len(self) > CACHE_SEGMENTS:
            self.clear()


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL,
                  ids: str = "ids") -> DataFrame:
    """``docs`` with the array<int> column ``ids`` (replacing one of that name):
    the piece ids of the whole text.  Null and empty texts give an empty array."""
    docs = docs.drop(ids)
    names = [*docs.columns, ids]
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def start():
        vocab = vocabulary(model)
        solved = _Solved(lambda s: np.array(vocab.encode_segment(s), "<i4").tobytes())

        def step(b: pa.RecordBatch):
            rows = [b"".join(map(solved.__getitem__, vocab.split(t))) for t in as_texts(b.column(at))]
            solved.trim()
            flat = np.frombuffer(b"".join(rows), "<i4")
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            return batch(*b.columns, col, names=names)
        return step
    return map_batches(docs, f"{schema}, `{ids}` array<int>", start)


def decode_pieces(rows: DataFrame, ids: str = "ids", model: str = MODEL,
                  out: str = "decoded") -> DataFrame:
    """``rows`` with the text ``out`` of the ids (null or empty ids: '')."""
    rows = rows.drop(out)
    names = [*rows.columns, out]
    at = rows.columns.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def start():
        vocab = vocabulary(model)

        def step(b: pa.RecordBatch):
            texts = [vocab.decode(r.values.to_numpy().tolist()) if r.is_valid else ""
                     for r in b.column(at)]
            return batch(*b.columns, pa.array(texts, pa.string()), names=names)
        return step
    return map_batches(rows, f"{schema}, `{out}` string", start)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 model: str = MODEL) -> DataFrame:
    """``id_col, n_tokens, score`` per row: the pieces of the whole text and the
    sum of their scores, without building the pieces.  Null or empty: 0, 0.0."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def start():
        vocab = vocabulary(model)
        solved = _Solved(vocab.count_segment)

        def step(b: pa.RecordBatch):
            n, total = [], []
            for t in as_texts(b.column(1)):
                got = list(map(solved.__getitem__, vocab.split(t)))
                n.append(sum(x for x, _ in got))
                total.append(float(sum(x for _, x in got)))
            solved.trim()
            return batch(b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                         names=[id_col, "n_tokens", "score"])
        return step
    return map_batches(rows, f"`{id_col}` {kind}, n_tokens bigint, score double", start)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode_pieces(encode_pieces(docs))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"),
                       F.length("decoded").cast("bigint").alias("decoded_chars"))
