"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the text around a turn, how roles are shown, which roles the loss counts and which role may follow
which: a finite-state machine whose state is the last role. Each conversation becomes segments (text, loss) whose
texts, joined, are the formatted conversation. Control strings inside texts are escaped with a backslash in such a way
that none of them occurs in an escaped text, so the turns can be read back by splitting.

Cases: a null text or role is empty; a role that the template does not name keeps its name, marked, and is an error of
the machine; turns of equal number are ordered by role, then text; an empty table gives no rows. Conversations whose order the
machine refuses are formatted all the same, with `valid` false. One conversation is one output value, so its turns meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"
    shown: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    #: (control string, escaped): applied in this order; each letter after the backslash stands for one character.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("</turn>", "\\l/turn>"), ("### ", "\\h## "))
    back: tuple[tuple[str, str], ...] = (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\"))


TEMPLATE = Template()


def escaped(text: Column, t: Template) -> Column:
    for plain, safe in t.escapes:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for safe, plain in t.back:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def chosen(keys: Column, options: dict[str, str], otherwise: Column) -> Column:
    out = None
    for k, v in options.items():
        out = F.when(keys == k, v) if out is None else out.when(keys == k, v)
    return out.otherwise(otherwise)


def format_conversations(df: DataFrame, template: Template = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid (whole order allowed), complete (ends where it may)."""
    t = template
    name, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    shown = chosen(name, t.shown, F.concat(F.lit("\\r"), F.replace(escaped(name, t), F.lit(":"), F.lit("\\c"))))
    one = F.struct(F.col(turn).alias("turn"), name.alias("role"), body.alias("text"), F.concat(F.lit(t.before), shown, F.lit(t.between)).alias("head"), escaped(body, t).alias("body"))
    turns = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["role"].isin(*t.loss)), segment(F.lit(t.after), F.lit(False)))))
    moves = F.create_map(*[F.lit(x) for a, bs in t.follows.items() for b in bs for x in (f"{a}>{b}", b)])
    state = F.aggregate("turns", F.lit(START), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit(ERROR)))
    out = turns.select("conv_id", segments.alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), (F.col("state") != ERROR).alias("valid"), F.col("state").isin(*t.ends).alias("complete"))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    t = template
    parts = F.split(formatted, "\\Q" + t.after + "\\E")
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        cut = F.instr(x, t.between)
        shown = F.substring(x, F.lit(len(t.before) + 1), cut - len(t.before) - 1)
        role = chosen(shown, {v: k for k, v in t.shown.items()}, unescaped(F.substring(shown, F.lit(3), F.length(shown)), t))
        return F.struct(role.alias("role"), unescaped(F.substring(x, cut + len(t.between), F.length(x)), t).alias("text"))

    return F.transform(parts, one)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""), template)


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the output gives back: number and digest of the turns, length and digest of the text under the loss mask."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    back = formatted.select("conv_id", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "complete")
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(joined).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars", "valid", "complete")
