"""Chat formatting: turns of typed parts become training text with a loss mask, and are read back from it.

1. A visitor flattens a turn's parts: text is escaped, an image, an audio clip or a document leaves an ordered
   placeholder, and its reference and the tokens that the placeholder stands for are recorded.
2. The template marks each turn: ``open`` role ``sep`` body ``close``.
3. Turns get their place and offset in their conversation by an ordered scan over ranges, so that a conversation
   with a third of all rows lies in many tasks. The mask covers the bodies of the ``learnt`` roles.

Escaping: a backslash is put behind every backslash, and behind the first sign of every control string, which is
then none any more. Taking single backslashes out and halving double ones gives the text again. It holds as no
control string has a backslash, and none has a first sign of one at a later place (``Template`` checks
that); so no control string can form across the ends of a body either.

Null texts, parts and roles are empty. Rows of null conversation make one conversation; rows of null turn come
first; rows that share a turn are ordered by role, body and references, and all are kept. An empty table
gives no rows. Columns beyond those read aren't carried, so their names can't clash. All of it is Spark's own functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import group_scan

#: A part as turns hold it; numbers that its kind doesn't have are null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of turns, placeholders of parts, and what a placeholder expands to."""
    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    other: str = "<|attachment|>"
    #: Control strings of other templates, which a tokenizer may know too.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learnt: tuple[str, ...] = ("assistant",)
    #: An image takes a token for each begun square of so many pixels, audio so many a second, a page so many.
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or _ESCAPE in c or firsts & set(c[1:]):
                raise ValueError(f"control string {c!r} can't be escaped")

    @property
    def placeholders(self) -> tuple[str, ...]:
        return self.image, self.audio, self.document, self.other

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.placeholders, *self.foreign)

    def visitors(self) -> dict[str, tuple[str, Callable[[Column], Column]]]:
        """For each kind but text: its placeholder, and the tokens that stand for a part."""
        squares = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / self.patch), F.lit(1))
        return {
            "image": (self.image, lambda p: squares(p["width"]) * squares(p["height"])),
            "audio": (self.audio, lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.per_second)),
            "document": (self.document, lambda p: F.coalesce(p["pages"], F.lit(1)) * self.per_page),
        }


def escape(text: Column, template: Template) -> Column:
    rests: dict[str, list[str]] = {}
    for c in template.controls:
        rests.setdefault(c[0], []).append(re.escape(c[1:]))
    places = [r"(?<=\\)", *(f"(?<={re.escape(a)})(?={'|'.join(b)})" for a, b in rests.items())]
    return F.regexp_replace(text, "|".join(places), r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """Parts of a turn that is one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(none.alias(n) for n in (
        "ref", "width", "height", "seconds", "pages"))).cast(PART))


def _visit(part: Column, template: Template) -> Column:
    """A part's piece of the body, and what is recorded of it (type null: text)."""
    kind = F.coalesce(part["type"], F.lit("text"))
    text = kind == "text"
    piece, tokens = F.lit(template.other), F.lit(1)
    for name, (placeholder, count) in template.visitors().items():
        piece = F.when(kind == name, F.lit(placeholder)).otherwise(piece)
        tokens = F.when(kind == name, count(part)).otherwise(tokens)
    return F.struct(F.when(text, F.coalesce(escape(part["text"], template), F.lit(""))).otherwise(piece).alias("piece"),
                    F.when(~text, kind).alias("type"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def format_turns(messages: DataFrame, template: Template | None = None) -> DataFrame:
    """``messages``: ``conv_id``, ``turn``, ``role``, ``parts`` (an array of ``PART``). One row a turn: ``conv_id``, ``turn``,
    ``position`` (from 0), ``formatted``, ``start`` (its offset in the conversation), ``loss_start`` and ``loss_chars`` (the
    mask, within the turn; null and 0 for roles that aren't learnt), ``attachments`` (ordinal, type, ref, tokens; in the
    order of the placeholders). Places and lengths are in code points."""
    t = template or Template()
    role = F.coalesce("role", F.lit(""))
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    pieces = F.transform(parts, lambda p: _visit(p, t))
    rows = messages.select(F.struct("conv_id").alias("conv"), "turn", role.alias("role"), pieces.alias("pieces"))
    rows = rows.select(
        "conv", "turn", "role", escape(F.col("role"), t).alias("name"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("body"),
        F.transform(F.filter("pieces", lambda p: p["type"].isNotNull()), lambda p, i: F.struct(
            i.cast("int").alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))
        ).alias("attachments"))
    head = F.concat(F.lit(t.open), "name", F.lit(t.sep))
    learnt = F.col("role").isin(*t.learnt)
    rows = rows.select("conv", "turn", "role", F.concat(head, "body", F.lit(t.close)).alias("formatted"),
                       F.when(learnt, F.length(head)).alias("loss_start"),
                       F.when(learnt, F.length("body")).otherwise(0).alias("loss_chars"), "attachments")
    rows = rows.withColumn("chars", F.length("formatted").cast("long")).withColumn(
        "refs", F.to_json(F.col("attachments")))
    placed = group_scan(rows, ["conv"], ["turn", "role", "formatted", "refs"], "chars")
    return placed.select(F.col("conv.conv_id").alias("conv_id"), "turn", (F.col("rank") - 1).alias("position"), "formatted",
                         F.col("prev_sum").alias("start"), "loss_start", "loss_chars", "attachments")


def assemble(turns: DataFrame) -> DataFrame:
    """One row a conversation, which is one training example: ``conv_id``, ``formatted``, ``loss`` (``start`` and ``stop`` of each
    masked stretch of it), ``attachments`` (all, in order, with the turn's ``position``), ``attachment_tokens``. A conversation
    must fit a cell (2 GB)."""
    found = F.struct("position", "formatted", "start", "loss_start", "loss_chars", "attachments")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(found)).alias("t"))
    at = lambda x: x["start"] + x["loss_start"]
    recorded = F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(
        x["position"].alias("position"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(
            at(x).alias("start"), (at(x) + x["loss_chars"]).alias("stop"))).alias("loss"),
        recorded.alias("attachments")).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _between(turn: Column, template: Template) -> tuple[Column, Column]:
    """Role and body of a formatted turn, as they stand in it."""
    inner = F.substring_index(F.substring_index(turn, template.open, -1), template.close, 1)
    return F.substring_index(inner, template.sep, 1), F.substring_index(inner, template.sep, -1)


def read_turn(turn: Column, template: Template | None = None) -> tuple[Column, Column]:
    """Role and text of a formatted turn (placeholders stand in the text as they are)."""
    role, body = _between(turn, template or Template())
    return unescape(role), unescape(body)


def read_parts(turn: Column, attachments: Column, template: Template | None = None) -> Column:
    """The parts of a formatted turn as ``type``, ``text``, ``ref``: its texts and attachments in order. Empty texts
    are left out, and texts that stood side by side are one."""
    t = template or Template()
    texts = F.split(_between(turn, t)[1], "|".join(re.escape(p) for p in t.placeholders), -1)
    part = lambda kind, text, ref: F.struct(kind.alias("type"), text.alias("text"), ref.alias("ref"))
    null = F.lit(None).cast("string")
    both = F.transform(F.arrays_zip(texts.alias("text"), attachments.alias("found")), lambda x: F.array(
        part(F.lit("text"), unescape(x["text"]), null), part(x["found"]["type"], null, x["found"]["ref"])))
    return F.filter(F.flatten(both), lambda p: p["type"].isNotNull() & ((p["type"] != "text") | (p["text"] != "")))


def read_conversation(formatted: Column, template: Template | None = None) -> Column:
    """Role and text of all turns of a conversation's text."""
    t = template or Template()
    turns = F.filter(F.split(formatted, re.escape(t.open), -1), lambda x: x != "")

    def read(turn: Column) -> Column:
        role, text = read_turn(turn, t)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(turns, read)


def masked(turn: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The text under a turn's mask; empty where there is none."""
    return F.coalesce(unescape(F.substring(turn, loss_start + 1, loss_chars)), F.lit(""))
