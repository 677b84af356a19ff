"""Chat text from conversations, by a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """What stands before and after a role's text, and whether the text is learnt."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of turns, the order of roles, and the escape.

    ``after`` lists the roles that may follow each role; ``start`` those that may
    come first, and a conversation may end after the roles in ``ends``. A role without an entry
    is written between the marks of ``other`` and ``then``. Opening marks must not be
    the beginning of one another.
    """

    roles: dict[str, Role]
    other: str = "<<ROLE>>"
    then: str = "<<TEXT>>"
    other_closes: str = "<</ROLE>>"
    start: tuple[str, ...] = ("system", "user")
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    @property
    def controls(self) -> list[str]:
        return [x for r in self.roles.values() for x in (r.opens, r.closes)] + [self.other, self.then, self.other_closes]


INSTRUCT = Template(
    {
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    }
)


def escaped(text: Column, t: Template) -> Column:
    """``text`` without control strings: the escape is doubled, and put after the first
    character of each control string."""
    out = F.replace(text, F.lit(t.escape), F.lit(2 * t.escape))
    for c in sorted({x.strip() for x in t.controls}):
        out = F.replace(out, F.lit(c), F.lit(c[0] + t.escape + c[1:]))
    return out


def unescaped(text: Column, t: Template) -> Column:
    """The inverse of ``escaped``. A single escape after a control string's first character
    was put there; those of the text itself come in twos."""
    out = text
    for c in sorted({x.strip() for x in t.controls}):
        out = F.replace(out, F.lit(c[0] + t.escape + c[1:]), F.lit(c))
    return F.replace(out, F.lit(2 * t.escape), F.lit(t.escape))


def format_chats(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: id, ``segments`` (text and loss flag), ``formatted``
    (their texts joined), ``valid`` and ``first_bad`` (the place of the first turn that the
    order of roles forbids, or else null).

    The order is a finite-state machine whose state is the last role. Every
    conversation is formatted, whether valid or not. Turns come in the order of turn, role and
    text, nulls first. Null texts and roles are empty; other roles keep their name
    in the marks. Rows repeated in full are turns of their own. Rows of a null id are
    one conversation. No rows give no rows. A conversation is one value, so its turns
    meet in one task.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    allowed = [f"{a}\n{b}" for a, bs in template.after.items() for b in bs] + [f"\n\n{b}" for b in template.start]

    def forbidden(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("turns"), i - 1)["role"]).otherwise(F.lit("\n"))
        return F.when(~F.concat(before, F.lit("\n"), t["role"]).isin(allowed), i)

    def segments(t: Column) -> Column:
        def of(opens: Column, closes: str, loss: bool) -> Column:
            return F.array(
                F.struct(opens.alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"], template).alias("text"), F.lit(loss).alias("loss")),
                F.struct(F.lit(closes).alias("text"), F.lit(False).alias("loss")),
            )

        other = of(F.concat(F.lit(template.other), escaped(t["role"], template), F.lit(template.then)), template.other_closes, False)
        return reduce(lambda rest, x: F.when(t["role"] == x[0], of(F.lit(x[1].opens), x[1].closes, x[1].loss)).otherwise(rest), template.roles.items(), other)

    bad = F.array_min(F.transform("turns", forbidden))
    last = F.element_at("turns", -1)["role"]
    out = chats.select(
        F.col(id_col),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        bad.alias("first_bad"),
        (bad.isNull() & last.isin(list(template.ends))).alias("valid"),
    )
    return out.select(id_col, "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "valid", "first_bad")


def parsed_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role and text) read back from formatted text."""
    ends = [r.closes for r in template.roles.values()] + [template.other_closes]
    pieces = F.split(formatted, "|".join(re.escape(x) for x in ends), -1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.then)
        out = F.struct(
            unescaped(F.substring(piece, F.lit(len(template.other) + 1), at - len(template.other) - 1), template).alias("role"),
            unescaped(F.substring(piece, at + len(template.then), F.length(piece)), template).alias("text"),
        )
        for name, r in template.roles.items():
            out = F.when(F.startswith(piece, F.lit(r.opens)), F.struct(F.lit(name).alias("role"), unescaped(F.substring(piece, F.lit(len(r.opens) + 1), F.length(piece)), template).alias("text"))).otherwise(out)
        return out

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learnt_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
