"""Chat formatting with Spark expressions: turns to one marked-up text, and back.

A conversation's turns are collected, sorted, merged where neighbours have the
same role, and joined::

    <|im_start|>user<|im_sep|>first text<|im_turn|>second text<|im_end|>
    <|im_start|>assistant<|im_sep|>...<|im_end|>

``<|im_turn|>`` keeps the turns of a merged block apart. Inside roles and texts
every ``<|`` is written ``<||``, so that no text can contain a control string;
reading turns ``<||`` back into ``<|``. The loss mask is a list of spans, in code
points of the formatted text: one for each assistant turn's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>\n"
#: Elements that a running total copies at once, so that long arrays take linear time.
CHUNK = 256
#: Code points in a piece of a formatted text that is read.
PIECE = 4096


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _merged(turns: str) -> Column:
    """Blocks of adjacent turns with the same role: the turns between two changes of role."""
    own, n = F.col(turns), F.size(turns)

    def changes(at: Column) -> Column:
        return (at == n) | (at == 0) | (F.element_at(own, F.greatest(at, F.lit(1)))["role"] != F.element_at(own, F.least(at + 1, n))["role"])

    ends = F.filter(F.sequence(F.lit(1), n), changes)
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(F.element_at(own, b)["role"].alias("role"), F.transform(F.slice(own, a + 1, b - a), lambda t: t["text"]).alias("texts")),
    )


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it, by a fold that copies its state: for short arrays."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(lengths, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))["sums"]


def _places(chunks: Column) -> Column:
    """For each element the sum of those before it; ``chunks`` are the elements in arrays of ``CHUNK``."""
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.flatten(F.zip_with(chunks, _running(totals), lambda c, before: F.transform(_running(c), lambda x: x + before)))


def _segments(blocks: Column, loss_role: str) -> Column:
    """The pieces of the formatted text in order, each with its loss flag."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def of(block: Column) -> Column:
        head = F.concat(F.lit(START), block["role"], F.lit(SEP))
        texts = F.transform(
            block["texts"],
            lambda t, i: F.array(
                piece(F.when(i > 0, F.lit(TURN)).otherwise(F.lit("")), no), piece(t, block["role"] == loss_role)
            ),
        )
        return F.concat(F.array(piece(head, no)), F.flatten(texts), F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(blocks, of))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` to ``conv_id, formatted, loss_spans``: one row per conversation.

    Turns stand by number; of equal numbers (null first) by role, then text; repeated
    rows are turns of their own. Null roles and texts count as empty. Null conv_ids are
    one conversation. Very long texts are only bounded by Spark's strings; an empty
    table gives no rows; other columns aren't read. A conversation is one row of the
    result, so its turns have to fit in a task.
    """
    empty = F.lit("")
    rows = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    turns = turns.select(
        "conv_id",
        F.transform(
            "turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))
        ).alias("turns"),
    )
    blocks = turns.select("conv_id", _merged("turns").alias("blocks"))
    parts = blocks.select("conv_id", _segments(F.col("blocks"), loss_role).alias("parts"))
    length = F.transform("parts", lambda p: F.char_length(p["text"]).cast("bigint"))
    parts = parts.select("conv_id", "parts", length.alias("lengths"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / CHUNK).cast("int")), lambda c: F.slice("lengths", c * CHUNK + 1, F.lit(CHUNK)))
    parts = parts.select("conv_id", "parts", "lengths", chunks.alias("chunks"))
    parts = parts.select("conv_id", "parts", "lengths", _places(F.col("chunks")).alias("places"))
    spans = F.zip_with(
        F.zip_with("parts", "lengths", lambda p, n: F.when(p["loss"], n)),
        "places",
        lambda n, at: F.when(n.isNotNull(), F.struct(at.alias("start"), (at + n).alias("stop"))),
    )
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        F.array_compact(spans).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` to ``conv_id, turns, loss_texts``: the original roles and texts.

    ``turns`` is an array of ``role, text``; ``loss_texts`` has the text under each span.
    """

    def exactly(control: str) -> str:
        return control.replace("|", r"\|")

    def turns_of(block: Column) -> Column:
        parts = F.split(block, exactly(SEP), -1)
        role = F.substring(parts[0], len(START) + 1, 2**31 - 1)
        return F.transform(
            F.split(parts[1], exactly(TURN), -1),
            lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")),
        )

    blocks = F.split(F.col("formatted"), exactly(END), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    # The text in pieces of as many code points each, so that a span is found without counting through all that is before it.
    pieces = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = formatted.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), "loss_spans", pieces.alias("pieces"))

    def under(span: Column) -> Column:
        first, last = (F.floor(span[c] / PIECE).cast("int") for c in ("start", "stop"))
        own = F.array_join(F.slice("pieces", first + 1, last - first + 1), "")
        return unescaped(own.substr((span["start"] - first * PIECE + 1).cast("int"), (span["stop"] - span["start"]).cast("int")))

    # Two uses keep the optimizer from writing the pieces out inside the function, where they would be made for each span.
    texts = F.when(F.size("pieces") >= 0, F.transform("loss_spans", under))
    return cut.select("conv_id", "turns", texts.alias("loss_texts"))
