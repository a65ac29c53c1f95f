"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds turns, which roles may follow each other, and whose text is trained on.

    ``moves`` maps a state to the states that may follow it; the state after a turn is its role. ``escapes`` are the
    characters that control strings need, each with its replacement; a backslash starts every replacement, so none
    of ``turn``, ``body`` and ``end`` can occur inside an escaped role or text.
    """

    begin: str = "<s>"
    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "</s>"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("<", "\\l"))
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    trained: tuple[str, ...] = ("assistant",)


def escaped(text: Column, template: Template) -> Column:
    for raw, safe in template.escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for raw, safe in reversed(template.escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Format all conversations of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, segments array<struct<text, loss>>, valid, ended. ``valid`` says that the state machine accepts
    every turn in order, ``ended`` that it stops in a final state. Every conversation is formatted, valid or not.

    Turns are sorted by (turn, role, text), nulls first. Null text and null role count as empty; repeated rows are
    turns of their own; a null conv_id is a conversation; an empty table gives an empty table; other columns are
    ignored. The turns of one conversation meet in one row, as its digest and its training example need them in
    one piece.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    chats = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    allowed = F.array(*[F.lit(f"{a}>{b}") for a, following in template.moves.items() for b in following])
    step = lambda s, t: F.when(F.array_contains(allowed, F.concat(s, F.lit(">"), t["role"])), t["role"]).otherwise(F.lit("!"))
    state = F.aggregate("turns", F.lit("start"), step)
    parts = F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.turn), escaped(t["role"], template), F.lit(template.body)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss"))))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    chats = chats.select("conv_id", F.concat(begin, F.flatten(parts)).alias("segments"), state.alias("state"))
    return chats.select("conv_id", "segments", (F.col("state") != "!").alias("valid"), F.col("state").isin(*template.final).alias("ended"))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted text says: conv_id, formatted, turns array<struct<role, text>>, trained array<string>.

    ``formatted`` joins the segments; the turns are split from it at the control strings and unescaped; ``trained``
    holds the unescaped texts under the loss mask.
    """
    segments = F.col("segments")
    formatted = F.array_join(F.transform(segments, lambda s: s["text"]), "")
    trained = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    out = chats.select("*", formatted.alias("formatted"), trained.alias("trained"))
    pieces = F.split("formatted", F.concat(F.lit(r"\Q"), F.lit(template.turn), F.lit(r"\E")), -1)
    out = out.withColumn("pieces", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.body, 1)
        start = F.length(role) + F.lit(len(template.body) + 1)
        body = F.substring(piece, start, F.length(piece) - start + F.lit(1 - len(template.end)))
        return F.struct(unescaped(role, template).alias("role"), unescaped(body, template).alias("text"))

    return out.withColumn("turns", F.transform("pieces", turn)).drop("pieces")


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, ended from the formatted text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("trained", "")
    return read_back(chats, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "ended")
