"""Chat formatting with Spark expressions only.

Template of a conversation (adjacent turns of one role are merged)::

    <|turn:ROLE|>\\nTEXT<|more|>TEXT<|end|>\\n   ... next merged turn ...

Inside texts and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (in
roles also ``>`` becomes ``\\>``), so no control string can appear in them and
removing each backslash before a character gives back the original.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK = 1024
OPEN, OPEN_END, MORE, END = "<|turn:", "|>\n", "<|more|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column, first: Column) -> Column:
    """``first`` and its sums with the entries, one after the other."""
    return F.aggregate(values, F.array(first), lambda acc, x: F.concat(
        acc, F.array(F.element_at(acc, -1) + x)))


def starts_of(lengths: Column, run: int = 256) -> Column:
    """Where each of the pieces of these lengths (array<bigint>) starts.  An array
    that grows is copied at each step, so sums are taken within runs, and the
    runs' own sums give where each begins."""
    zero = F.lit(0).cast("bigint")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def all_but_last(a: Column) -> Column:
        return F.slice(a, F.lit(1), F.size(a) - 1)
    runs = let(lengths, lambda n: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(n) - 1) / run).cast("int")),
        lambda j: F.slice(n, j * run + 1, F.lit(run))))
    return let(runs, lambda r: F.flatten(F.zip_with(
        r, all_but_last(_sums(F.transform(r, total), zero)),
        lambda part, at: all_but_last(_sums(part, at)))))


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``
    (code point ranges, end exclusive, of the texts of ``loss_role``, without
    control strings).

    Turns are ordered by (turn, role, text); a null turn sorts first, a null
    role or text is empty, repeated rows are repeated turns, the rows with a
    null conversation id form one conversation.  Adjacent turns of one role are
    merged under one header; ``<|more|>`` keeps their border, so it can be read
    back."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    # where a merged turn starts, and one past the last
    starts = turns.select("conv_id", "turns", F.filter(
        F.sequence(F.lit(0), F.size("turns")),
        lambda i: (i == 0) | (i == F.size("turns"))
        | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])).alias("at"))
    merged = starts.select("conv_id", F.transform(
        F.sequence(F.lit(0), F.size("at") - 2),
        lambda k: F.struct(
            F.get("turns", F.get("at", k))["role"].alias("role"),
            F.transform(
                F.slice("turns", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k)),
                lambda t: escape(t["text"])).alias("texts"))).alias("merged"))
    # the pieces of the output, each with its loss flag
    def piece(c: Column, loss: Column | bool) -> Column:
        flag = F.lit(loss) if isinstance(loss, bool) else loss
        return F.struct(c.alias("s"), flag.alias("loss"))

    def pieces(m: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit(OPEN_END))
        return F.concat(
            F.array(piece(head, False)),
            F.flatten(F.transform(m["texts"], lambda t, i: F.array(
                piece(F.when(i > 0, F.lit(MORE)).otherwise(F.lit("")), False),
                piece(t, m["role"] == loss_role)))),
            F.array(piece(F.lit(END), False)))

    cut = merged.select("conv_id", F.flatten(F.transform("merged", pieces)).alias("pieces"))
    spans = F.zip_with("pieces", starts_of(F.transform("pieces", lambda p: F.length(p["s"]).cast("bigint"))),
                       lambda p, at: F.struct(at.alias("start"), (at + F.length(p["s"])).alias("end"),
                                              p["loss"].alias("loss")))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]),
                    lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, texts>> parsed from a formatted conversation."""
    blocks = F.split(formatted, r"<\|end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def block(b: Column) -> Column:
        role = F.substring_index(F.substring(b, len(OPEN) + 1, 2**31 - 1), "|>", 1)
        body = F.substring(b, F.lit(len(OPEN) + len(OPEN_END) + 1) + F.length(role),
                           F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), F.transform(
            F.split(body, r"<\|more\|>", -1), unescape).alias("texts"))
    return F.transform(blocks, block)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array.  The text is cut
    once into chunks of ``CHUNK`` code points, as a substring is found by
    walking to it; a span is read from the chunks that it lies in."""
    def text(chunks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / CHUNK).cast("int")
        last = F.floor(s["end"] / CHUNK).cast("int")
        return unescape(F.substring(
            F.array_join(F.slice(chunks, first + 1, last - first + 1), ""),
            (s["start"] - first * CHUNK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)),
               lambda chunks: F.transform(spans, lambda s: text(chunks, s)))


#: A conversation that quotes control strings, formatted with the others.
TRAP_SQL = r"""SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'),
 (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_chats(rows.unionByName(spark.sql(TRAP_SQL)))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                      read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.flatten(F.transform("turns", lambda m: F.transform(
        m["texts"], lambda t: F.concat(m["role"], F.lit("\n"), t, F.lit("\n")))))
    return read.select(
        "conv_id",
        F.aggregate("turns", F.lit(0).cast("bigint"),
                    lambda a, m: a + F.size(m["texts"])).alias("n_turns"),
        F.sha2(F.array_join(flat, ""), 256).alias("turns_sha256"),
        F.aggregate("loss", F.lit(0).cast("bigint"),
                    lambda a, t: a + F.length(t)).alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role
            AND row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 1 AS more,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_len,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '>', '\>')) AS role_len
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + CASE WHEN more THEN 8 ELSE 7 + role_len + 3 + 8 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
