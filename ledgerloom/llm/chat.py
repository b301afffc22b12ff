"""Chat formatting: conversations as marked text with a loss flag per segment, with DataFrame functions only.

A template is data: the markers around a turn of each role, the moves of a finite-state machine over roles, and the roles
whose texts are learned. Each turn gives three segments: opening marker, text, closing marker; only texts of learned roles
carry the loss flag. Control strings inside texts are escaped with a backslash and a letter, backslashes
first, so `unescaped` gives every text back.

A formatted conversation is one training example, so its turns meet in one row; its turns are collected once, by one shuffle.

Defined results: turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own; null text and
null role are empty; a role without markers of its own is written into a general marker; a null conv_id is a
conversation of its own; a conversation that breaks the turn order is formatted too, with valid false and the first turn that
breaks it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers by role, moves (state, role) -> state, states that may end, learned roles."""

    opening: dict[str, str] = field(default_factory=lambda: {
        "system": "<s><<SYS>>", "user": "<s>[INST] ", "assistant": "[ANSWER] "})
    closing: dict[str, str] = field(default_factory=lambda: {
        "system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"})
    other_opening: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other_closing: str = "[END]"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "asked", ("system", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        ("asked", "tool"): "asked", ("answered", "tool"): "asked"})
    final: tuple[str, ...] = ("answered",)
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """The strings that must not stand in a text, longest first."""
        found = {*self.opening.values(), *self.closing.values(), *self.other_opening, self.other_closing}
        parts = {p for c in found for p in (c.strip(), "<s>") if p} | {"[INST]", "<<SYS>>"}
        return sorted(parts, key=lambda c: (-len(c), c))

    def escapes(self) -> dict[str, str]:
        """What stands for what: the backslash first, then each control string."""
        return {"\\": "\\b"} | {c: "\\" + chr(ord("c") + i) for i, c in enumerate(self.controls())}


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    for plain, safe in template.escapes().items():
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column, template: Template = CHAT) -> Column:
    for plain, safe in reversed(template.escapes().items()):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _by_role(role: Column, known: dict[str, str], other: Column) -> Column:
    out = other
    for name, marker in known.items():
        out = F.when(role == name, F.lit(marker)).otherwise(out)
    return out


def _opening(role: Column, template: Template) -> Column:
    general = F.concat(F.lit(template.other_opening[0]), escaped(role, template), F.lit(template.other_opening[1]))
    return _by_role(role, template.opening, general)


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = CHAT,
) -> DataFrame:
    """One row per conversation: conv_id, valid, broken_at (number of the first turn out of order, from 0), and
    segments, an array of kind (open, text, close), text and loss."""
    turns = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, name), to in template.moves.items() for x in (f"{state} {name}", to)])

    def step(state: Column, one: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws(" ", state["state"], one["role"]))
        return F.struct(F.coalesce(to, F.lit("broken")).alias("state"),
                        (state["passed"] + F.when(to.isNull(), 0).otherwise(1)).alias("passed"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("passed"))

    def segments(one: Column) -> Column:
        def segment(kind: str, text: Column, loss: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        return F.array(
            segment("open", _opening(one["role"], template), no),
            segment("text", escaped(one["text"], template), one["role"].isin(*template.learned)),
            segment("close", _by_role(one["role"], template.closing, F.lit(template.other_closing)), no))

    end = F.aggregate("turns", start, step)
    return turns.withColumn("end", end).select(
        "conv_id", F.col("end.state").isin(*template.final).alias("valid"),
        F.when(F.col("end.passed") < F.size("turns"), F.col("end.passed")).alias("broken_at"),
        F.flatten(F.transform("turns", segments)).alias("segments"))


def formatted(segments: str | Column = "segments") -> Column:
    """The text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(segments: str | Column = "segments", template: Template = CHAT) -> Column:
    """Role and text of each turn, read back from the markers and the escaped texts."""
    first, last = template.other_opening

    def role(marker: Column) -> Column:
        inner = F.substring(marker, F.lit(len(first) + 1), F.length(marker) - len(first) - len(last))
        out = unescaped(inner, template)
        for name, known in template.opening.items():
            out = F.when(marker == known, F.lit(name)).otherwise(out)
        return out

    whole = F.col(segments) if isinstance(segments, str) else segments
    openings = F.filter(whole, lambda s: s["kind"] == "open")
    texts = F.filter(whole, lambda s: s["kind"] == "text")
    return F.zip_with(openings, texts, lambda a, b: F.struct(
        role(a["text"]).alias("role"), unescaped(b["text"], template).alias("text")))


def learned_text(segments: str | Column = "segments", template: Template = CHAT) -> Column:
    """All text under the loss flag, unescaped, in order."""
    whole = F.col(segments) if isinstance(segments, str) else segments
    under = F.filter(whole, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
