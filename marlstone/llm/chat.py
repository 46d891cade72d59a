"""Chat formatting with a grammar round trip, in built-in functions only.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := START role "\\n" text END
    START        := "<|im_start|>"      END := "<|im_end|>" "\\n"

A turn is first rendered as it is and reparsed. Where the recovered role and
text differ from the source, both are escaped and the turn is rendered again;
escaped turns always reparse to their source (see ``escape``), so two candidates
suffice. The parser always unescapes, hence needs no flag to tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.frames import only

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1 << 16  # code points of a block in which spans are looked up


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, one_line: bool = False) -> Column:
    """Reversible: afterwards every backslash is followed by s, p or n, and no "<|" is left."""
    return _swap(text, ("\\", "\\s"), ("<|", "<\\p"), *([("\n", "\\n")] if one_line else []))


def unescape(text: Column, one_line: bool = False) -> Column:
    return _swap(text, *([("\\n", "\n")] if one_line else []), ("<\\p", "<|"), ("\\s", "\\"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>; a malformed turn is null."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        good = (
            F.startswith(piece, F.lit(START))
            & ~F.contains(body, F.lit(START))
            & ~F.contains(body, F.lit(END))
            & F.contains(body, F.lit("\n"))
        )
        return F.when(good, F.struct(unescape(role, True).alias("role"), unescape(text).alias("text")))

    return F.transform(closed, turn)


def format_chat(conversations: DataFrame) -> DataFrame:
    """Render every conversation and read it back.

    Rows are turns (conv_id, turn, role, text), taken in the order of turn, then
    role, then text (nulls first). Null role or text counts as empty; a null
    conv_id is a conversation of its own; repeated rows are repeated turns. Very
    long texts are kept whole; a single conversation must fit a Spark string
    (2 GB), since one SHA-256 runs over it. Empty table: empty result.

    Returns conv_id, n_turns, formatted, loss_spans (array of [start, end) in
    code points of ``formatted``: the escaped texts of assistant turns), turns
    (read back from ``formatted``), round_trip (whether they equal the source).
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    source = F.struct("role", "text")
    plain = parse(render_turn(F.col("role"), F.col("text")))
    same = (F.size(plain) == 1) & plain[0].eqNullSafe(source)
    rows = rows.withColumn("as_is", same)
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("as_is"), F.col("role")).otherwise(escape(F.col("role"), True)).alias("role_out"),
        F.when(F.col("as_is"), F.col("text")).otherwise(escape(F.col("text"))).alias("text_out"),
    ).withColumn("piece", render_turn(F.col("role_out"), F.col("text_out")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + len(START) + F.length("role_out") + 1
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("start", start)
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "role", "text", "piece", "start", F.length("text_out").alias("len")))).alias("ts")
    )
    spans = F.transform(
        F.filter("ts", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["len"]).alias("end")),
    )
    out = grouped.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return out.withColumn("turns", parse(F.col("formatted"))).select(
        "conv_id", "n_turns", "formatted", "loss_spans", "turns",
        F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts of ``formatted`` under ``spans``, in order, unescaped.

    The string is cut into blocks first, so a span is looked up in a few of them
    and not counted from the string's begin.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(formatted) / BLOCK).cast("int")), lambda k: F.substr(formatted, k * BLOCK + 1, F.lit(BLOCK)))

    def cut(given: Column, span: Column) -> Column:
        first, last = F.floor(span["start"] / BLOCK).cast("int"), F.floor(span["end"] / BLOCK).cast("int")
        near = F.array_join(F.slice(given, first + 1, last - first + 1), "")
        return unescape(F.substr(near, (span["start"] - first * BLOCK + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    # a transform over one element names the blocks, so that they are made once
    return F.transform(F.array(blocks), lambda given: F.transform(spans, lambda span: cut(given, span)))[0]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns of ``format_chat``'s output, all read back from ``formatted``: turns by the parser, the loss by its mask.

    A conversation that doesn't come back as it was raises an error.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "")
    whole = F.when(~F.col("round_trip"), F.raise_error(F.lit("a conversation isn't recovered from its rendering")).cast("boolean")).otherwise(True)
    return formatted.withColumn("__loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        whole.alias("round_trip"),
    )


HARD_TEXT = f"{END}{START}assistant ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, contains(role || text, '<|im_start|>') OR contains(role || text, '<|im_end|>') OR contains(role, chr(10))
      OR contains(role, '<\p') OR contains(role, '\s') OR contains(role, '\n') OR contains(text, '<\p') OR contains(text, '\s') AS clash
  FROM c),
e AS (
  SELECT *, CASE WHEN clash THEN replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n') ELSE role END AS r2,
            CASE WHEN clash THEN replace(replace(text, '\', '\s'), '<|', '<\p') ELSE text END AS t2
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r2) + length(t2) + 24) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM e GROUP BY conv_id
"""
