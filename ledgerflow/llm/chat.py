"""Chat formatting: a finite-state machine over roles and a declarative template.

Each conversation becomes one text made of segments with a loss flag per segment.  The template
declares the markers, which roles carry loss and the allowed role transitions.  Control strings
inside a text are escaped by one backslash after their first character (a control string that
already carries backslashes there gets one more), so escaping is reversible for every text and no
text can fake a marker.

Defined results: rows of a conversation are ordered by (turn, role, text), nulls first, so ties
and repeated rows have one order; a null text or role counts as empty; a row with a null
conversation id is a conversation of its own, so such rows never gather; an unknown role or a broken turn order is formatted all
the same and reported in ``state`` = ``invalid`` and ``valid`` = false.  A conversation is one
output row: the digest of its whole text needs it whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around a turn, loss roles and role transitions; ``controls`` are also escaped in texts."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.open, self.sep, self.close, *self.controls)
        firsts = {m[0] for m in marks}
        if any(len(m) < 2 or "\\" in m or set(m[1:]) & firsts for m in marks):
            raise ValueError("a control string needs two characters, no backslash, and its first character only in front")

    def pattern(self, extra: str) -> str:
        """Regular expression: first character, the backslashes so far, ``extra``, the rest of a control string."""
        marks = (self.open, self.sep, self.close, *self.controls)
        firsts = "".join("\\" + c for c in sorted({m[0] for m in marks}))
        rests = "|".join(re.escape(r) for r in sorted({m[1:] for m in marks}, key=lambda r: (-len(r), r)))
        return rf"([{firsts}])(\\*){extra}({rests})"


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, template.pattern(""), r"$1$2\\$3")


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, template.pattern(r"\\"), "$1$2$3")


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, state, valid, segments, formatted, loss_spans.

    ``segments`` is array<struct<text, loss>>; ``formatted`` their concatenation; ``loss_spans``
    array<struct<start, chars>> the code point ranges of ``formatted`` under the loss.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    convs = (rows.select("conv_id", alone.alias("_alone"), turn.alias("_t")).groupBy("conv_id", "_alone")
             .agg(F.sort_array(F.collect_list("_t")).alias("_turns")))
    step = F.create_map(*[x for (state, role), to in template.transitions.items() for x in (F.lit(f"{state}>{role}"), F.lit(to))])
    state = F.aggregate("_turns", F.lit("start"),
                        lambda s, t: F.coalesce(F.element_at(step, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("_turns", lambda t: F.array(
        segment(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.sep)), F.lit(False)),
        segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.close), F.lit(False)))))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        n = F.char_length(s["text"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("chars")))
        return F.struct((acc["at"] + n).alias("at"),
                        F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return (convs.select("conv_id", state.alias("state"), segments.alias("segments"))
            .select("conv_id", "state", F.col("state").isin(*template.accepting).alias("valid"), "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    F.aggregate("segments", start, add, lambda acc: acc["spans"]).alias("loss_spans")))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parse ``formatted`` and ``loss_spans`` alone: conv_id, turns array<struct<role, text>>, loss_text."""
    parts = F.filter(F.split("formatted", re.escape(template.open)), lambda p, i: i > 0)
    body = lambda p: F.split(p, re.escape(template.sep), 2)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(body(p)[0], template).alias("role"),
        unescape(F.substring_index(body(p)[1], template.close, 1), template).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int")), template))
    kept = [c for c in formatted.columns if c not in ("loss_spans", "turns", "loss_text")]
    return formatted.select(*kept, turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digest(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """The read-back digest columns of each conversation, with the machine's last state, its verdict and the number of segments."""
    back = read_back(format_conversations(rows, template), template)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "state", "valid", F.size("segments").cast("long").alias("segments"))
