"""Conversations as training text: turn order checked by a finite-state machine, text segments with loss flags.

A `Template` declares everything: what stands before and after a turn of each role, whether its text is trained on,
which role may follow which state, and where a conversation may end. `format_conversations` folds the machine over
the turns of a conversation and emits its segments (markers and texts, each with its loss flag); `formatted_text`
joins them; `parsed_turns` reads the turns back from that text alone. All of it is DataFrame functions.

Texts cannot forge markers: where a text holds a control string of the template, a backslash goes in after its first
character (one more if there are some already), so no control string stands in an escaped text, and taking one
backslash out again restores it. `Template` refuses control strings that could overlap, for which that would not hold.

Defined cases: turns are ordered by turn number, then role, then text, nulls first, and repeated rows stay repeated
turns; a null text is empty; a role the template does not know, or a null one, gets a general marker that carries the
role, and is a step the machine does not know. A step that the machine does not allow does not drop the conversation:
`first_invalid` says which turn it was (from 1; null if none), and the machine goes on in the state that the role names.
`complete` holds if there was no such turn and the last state may end a conversation. Rows without a conversation id
belong to no conversation: each becomes one of its own, with a null id. Empty tables give no rows. Only the named
columns are read, so others may have any name. A conversation is one row of the result; its turns meet in the task
that builds this row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\\"


@dataclass(frozen=True)
class Turn:
    """What stands before and after the text of a turn, and whether texts, and the end markers, are trained on."""

    open: str
    close: str
    loss: bool = False
    close_loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role; `steps` maps a state to the roles that may come next (the state after them has the role's name)."""

    start: str
    turns: dict[str, Turn]
    steps: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    other_role: str = "<|role|>"
    other_open: str = "<|text|>"
    other_close: str = "<|end|>"
    more_controls: tuple[str, ...] = ()
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        literals = [self.start, self.other_role, self.other_open, self.other_close, *self.more_controls]
        literals += [x for t in self.turns.values() for x in (t.open, t.close)]
        controls = tuple(dict.fromkeys(c for x in literals for c in x.split()))
        object.__setattr__(self, "controls", controls)
        if any(MARK in c or len(c) < 2 for c in controls):
            raise ValueError("control strings need two characters or more, and no backslash")
        leads = {c[0] for c in controls}
        rests = {c[1:] for c in controls}
        for rest in rests:
            for at in range(len(rest)):
                tail = rest[at + 1:]
                if rest[at] in leads and any(tail.startswith(other) or other.startswith(tail) for other in rests):
                    raise ValueError(f"control strings overlap at {rest[at:]!r}")
        closes = [t.close for t in self.turns.values()] + [self.other_close]
        if any(a.endswith(b) for i, a in enumerate(closes) for b in closes[:i] + closes[i + 1:]) or not all(c.split() for c in closes):
            raise ValueError("each role needs an end marker of its own, not the end of another's")
        if any(not c[0] in leads and not c[0].isspace() for c in closes):
            raise ValueError("an end marker begins with a control string or white space")


# the marks of a well-known instruction format, one closing mark for each role
INSTRUCT = Template(
    start="<s>",
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    steps={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("user", "assistant"),
)


def _any_of(strings) -> str:
    return "|".join(re.escape(s) for s in sorted(strings, key=lambda s: (-len(s), s)))


def _leads(template: Template) -> str:
    return "(" + _any_of({c[0] for c in template.controls}) + ")"


def _rests(template: Template) -> str:
    return "(" + _any_of({c[1:] for c in template.controls}) + ")"


def escaped(text: Column, template: Template = INSTRUCT) -> Column:
    """`text` without any control string; `unescaped` gives it back."""
    pattern = f"{_leads(template)}(\\\\*){_rests(template)}"
    return F.regexp_replace(text, pattern, "$1$2\\\\$3")


def unescaped(text: Column, template: Template = INSTRUCT) -> Column:
    pattern = f"{_leads(template)}\\\\(\\\\*){_rests(template)}"
    return F.regexp_replace(text, pattern, "$1$2$3")


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _turn_segments(role: Column, text: Column, template: Template) -> Column:
    """The three segments of a turn: its opening, its escaped text, its end."""
    body = escaped(F.coalesce(text, F.lit("")), template)
    named = F.concat(F.lit(template.other_role), escaped(role, template), F.lit(template.other_open))
    other = F.array(_segment(F.coalesce(named, F.lit(template.other_open)), False), _segment(body, False),
                    _segment(F.lit(template.other_close), False))
    out = None
    for name, turn in template.turns.items():
        segments = F.array(_segment(F.lit(turn.open), False), _segment(body, turn.loss), _segment(F.lit(turn.close), turn.close_loss))
        out = F.when(role == name, segments) if out is None else out.when(role == name, segments)
    return other if out is None else out.otherwise(other)


def _checked(roles: Column, template: Template) -> Column:
    """struct(state, at, first_invalid): the machine after all `roles`; a state is the last role, '' at the start."""
    def allowed(state: Column, role: Column) -> Column:
        out = F.lit(False)
        for name, after in template.steps.items():
            if after:
                out = out | ((state == name) & role.isin(*after))
        return F.coalesce(out, F.lit(False))

    begin = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first_invalid"))
    return F.aggregate(roles, begin, lambda m, role: F.struct(
        F.coalesce(role, F.lit("")).alias("state"), (m["at"] + 1).alias("at"),
        F.coalesce(m["first_invalid"], F.when(~allowed(m["state"], role), m["at"] + 1)).alias("first_invalid")))


def format_conversations(df: DataFrame, template: Template = INSTRUCT, *, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, first_invalid, complete, segments): one row for each conversation, its segments in order."""
    rows = df.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    together = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("turns"))
    machine = together.unionByName(alone).select(
        "conv_id", "turns", _checked(F.transform("turns", lambda t: t["role"]), template).alias("machine"))
    segments = F.flatten(F.transform("turns", lambda t: _turn_segments(t["role"], t["text"], template)))
    return machine.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("machine.first_invalid").alias("first_invalid"),
        (F.col("machine.first_invalid").isNull() & F.col("machine.state").isin(*template.ends)).alias("complete"),
        F.concat(F.array(_segment(F.lit(template.start), False)), segments).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask as it was before escaping, nothing between its segments."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def parsed_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array of struct(role, text): the turns, read back from the formatted text alone."""
    body = F.substring(formatted, F.lit(len(template.start) + 1), F.length(formatted))
    closes = [t.close for t in template.turns.values()] + [template.other_close]
    pieces = F.regexp_extract_all(body, F.lit(f"(?s)(.*?)({_any_of(closes)})"), F.lit(0))

    def between(piece: Column, before: str, after: str) -> Column:
        return F.substring(piece, F.lit(len(before) + 1), F.length(piece) - (len(before) + len(after)))

    def plain(role: Column, value: Column) -> Column:
        return F.struct(role.alias("role"), unescaped(value, template).alias("text"))

    def turn_of(piece: Column) -> Column:
        inner = between(piece, "", template.other_close)
        named = piece.startswith(template.other_role)
        at = F.instr(inner, template.other_open)
        role = F.when(named, unescaped(F.substring(inner, F.lit(len(template.other_role) + 1), at - 1 - len(template.other_role)), template))
        rest = F.substring(inner, at + len(template.other_open), F.length(inner))
        out = None
        for name, turn in template.turns.items():
            value = plain(F.lit(name), between(piece, turn.open, turn.close))
            out = F.when(piece.endswith(turn.close), value) if out is None else out.when(piece.endswith(turn.close), value)
        other = plain(role, rest)
        return other if out is None else out.otherwise(other)

    return F.transform(pieces, turn_of)
