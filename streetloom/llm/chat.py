"""Chat formatting with Spark expressions only.

Template: adjacent turns of one role form a block; a block is a header
``### role: `` and its texts, each ended by ``</turn>`` and a line feed. Inside
roles and texts a backslash is doubled and every control string becomes a
backslash and one letter, so no control string is left in them, a formatted
conversation splits in one way only, and escaping can be undone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

HEAD, COLON, STOP = "### ", ": ", "</turn>"
END = STOP + "\n"
#: Control strings and the letter that stands for each behind a backslash.
LETTERS = {STOP: "e", HEAD: "h"}
ROLE_LETTERS = LETTERS | {":": "c"}
PART = 512  # turn numbers collected at once, before the parts of a conversation meet


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often and wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape(text: Column, letters: dict[str, str] = LETTERS) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in letters.items():
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return out


def unescape(text: Column, letters: dict[str, str] = LETTERS) -> Column:
    def plain(part: Column) -> Column:
        for control, letter in letters.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(control))
        return part

    # A pair of backslashes can only begin where an escape begins, so splitting at pairs is safe.
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _ends(lengths: Column) -> Column:
    """Running sums of an array: sums of runs of 64 first, then inside each run."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int"))), lambda k: F.slice(lengths, k * 64 + 1, 64))
    zero = F.lit(0).cast("long")

    def total(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: acc + x)

    def cumulative(xs: Column, start: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: start + total(F.slice(xs, 1, i)))

    def add(acc: Column, xs: Column) -> Column:
        return F.struct((acc["at"] + total(xs)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    starts = F.aggregate(runs, F.struct(zero.alias("at"), F.array().cast("array<long>").alias("starts")), add)["starts"]
    summed = F.flatten(F.zip_with(runs, starts, cumulative))
    return F.when(F.size(lengths) > 0, summed).otherwise(F.array().cast("array<long>"))


def _blocks(turns: Column) -> Column:
    """Array aggregation of turns into ``(role, texts)``, one for each run of equal roles."""

    def cut(starts: Column) -> Column:
        stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
        return F.zip_with(starts, stops, lambda s, e: F.struct(
            escape(F.get(turns, s)["role"], ROLE_LETTERS).alias("role"),
            F.transform(F.slice(turns, s + 1, e - s), lambda t: escape(t["text"])).alias("texts"),
            (F.get(turns, s)["role"]).alias("plain_role"),
        ))

    numbered = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))
    return let(F.filter(numbered, lambda i: i.isNotNull()), cut)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One formatted text and its loss spans for every conversation.

    Returns ``conv_col, formatted, loss`` with ``loss`` an array of
    ``(start, stop)`` in code points of ``formatted``, one for each turn of
    ``loss_role``: the turn's escaped text, without header and end mark.

    Turns are ordered by number, role and text; null numbers come first. Null
    roles and texts count as empty. Repeated rows are repeated turns. Rows with
    a null conversation form one conversation. No rows give no rows. Turns
    first meet in parts of 512 turn numbers; only those parts meet in a row, as
    one formatted text is one value.
    """
    columns_of(turns, conv_col, turn_col, role_col, text_col)
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    parts = rows.groupBy("conv", F.floor(F.col("turn") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("parts"))

    def layout(blocks: Column) -> Column:
        """Pieces of each turn in order: its header (or nothing) and its text."""
        return F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t, i: F.struct(
            F.when(i == 0, F.concat(F.lit(HEAD), b["role"], F.lit(COLON))).otherwise("").alias("head"),
            t.alias("text"), (b["plain_role"] == loss_role).alias("learn"),
        ))))

    def finish(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: (F.length(p["head"]) + F.length(p["text"]) + len(END)).cast("long"))
        stops = F.transform(_ends(lengths), lambda e: e - len(END))
        spans = F.zip_with(pieces, stops, lambda p, e: F.when(p["learn"], F.struct((e - F.length(p["text"])).alias("start"), e.alias("stop"))))
        return F.struct(
            F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
            F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
        )

    flat = F.flatten(F.transform("parts", lambda p: p["turns"]))
    made = let(flat, lambda turns: let(_blocks(turns), lambda blocks: let(layout(blocks), finish)))
    return whole.select(F.col("conv").alias(conv_col), made.alias("made")).select(conv_col, "made.formatted", "made.loss")


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` in a formatted text, as an array.

    A turn without a header of its own has the role of the turn before.
    """
    pieces = F.split(formatted, F.lit(STOP + "\n"), -1)

    def parse(piece: Column) -> Column:
        role = F.when(F.startswith(piece, F.lit(HEAD)), F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), ":", 1))
        skip = F.coalesce(F.length(role) + len(HEAD) + len(COLON), F.lit(0))
        return F.struct(unescape(role, ROLE_LETTERS).alias("role"), unescape(F.substr(piece, skip + 1)).alias("text"))

    def with_roles(turns: Column) -> Column:
        own = F.filter(F.transform(turns, lambda t, i: F.when(t["role"].isNotNull(), i)), lambda i: i.isNotNull())

        def fill(starts: Column) -> Column:
            stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
            return F.flatten(F.zip_with(starts, stops, lambda s, e: F.transform(
                F.slice(turns, s + 1, e - s), lambda t: F.struct(F.get(turns, s)["role"].alias("role"), t["text"].alias("text")))))

        return let(own, fill)

    return let(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse), with_roles)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans, as an array."""
    return let(formatted, lambda text: F.transform(loss, lambda s: unescape(F.substr(text, s["start"] + 1, s["stop"] - s["start"]))))
