"""Conversations of typed parts as training text, and back.

A turn's content is an array of parts. A visitor visits them in order: text is escaped, an image, a piece of audio or a
document becomes a placeholder, whose reference and number of tokens after expansion are recorded. A turn's role puts
control strings around it. Inside texts and roles every control string gets a backslash after its first character (one
more, if it had some), so none is left there, and taking one away brings the text back.

Turns are formatted where they are, as column expressions; then a conversation's turns stream past in order and are put
together in chunks of whole turns, so that a conversation of any length is never held. Joined in order, chunks are the
conversation. Positions under the loss mask count code points from the conversation's start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelake.llm.streams import Rows, in_order, stream

#: What stands before and after a turn; the role is written out where it is neither of the two.
AROUND = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, AFTER_ROLE, END = "[ROLE]", "[/ROLE]", "[/TURN]"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
CONTROLS = [*(c for pair in AROUND.values() for c in pair), ROLE, AFTER_ROLE, END, *PLACEHOLDERS.values()]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)

#: A part; all but its kind may be null.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
CHUNK_CHARS = 1 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*)({_TAILS})", r"$1\\$2$3")


_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]",
    re.DOTALL,
)
_PLACEHOLDER = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))
_KINDS = {p: kind for kind, p in PLACEHOLDERS.items()}


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Visitor:
    """What each kind of part becomes, and how many tokens a placeholder stands for: one for each started patch of an
    image, each started `1 / audio_rate` seconds of audio, `page_tokens` for each page; at least one."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 1024

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(part["text"]), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["image"]), F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["audio"]), F.ceil(part["seconds"] * self.audio_rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["document"]), part["pages"] * self.page_tokens

    def visit(self, part: Column) -> Column:
        """`kind`, `content`, `ref` and `tokens` of a part; an unknown or null kind is text."""
        content, tokens = self.text(part)
        kind, ref = F.lit("text"), F.lit(None).cast("string")
        for name in PLACEHOLDERS:
            placed, stands_for = getattr(self, name)(part)
            here = part["kind"] == name
            content = F.when(here, placed).otherwise(content)
            tokens = F.when(here, F.greatest(F.coalesce(stands_for, F.lit(0)), F.lit(1))).otherwise(tokens)
            kind, ref = F.when(here, name).otherwise(kind), F.when(here, part["ref"]).otherwise(ref)
        return F.struct(
            kind.alias("kind"), content.alias("content"), ref.alias("ref"), tokens.cast("long").alias("tokens")
        )


def text_part(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    fields = [field.split(": ") for field in PART.removeprefix("struct<").removesuffix(">").split(", ")]
    known = {"kind": F.lit("text"), "text": text}
    return F.array(F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))


_SPANS = "array<struct<start: bigint, end: bigint>>"
_ATTACHED = "array<struct<kind: string, ref: string, tokens: bigint>>"
_CHUNKS = "conv_id {kind}, chunk int, formatted string, n_turns int, loss " + _SPANS + ", attachments " + _ATTACHED
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHMENT = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame, role: str, parts: str, visitor: Visitor) -> DataFrame:
    """`turns` with `formatted`, `loss` (positions in it) and `attachments`: a projection, without a shuffle."""
    visited = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visitor.visit)
    named = F.coalesce(F.col(role), F.lit(""))
    before = F.concat(F.lit(ROLE), escaped(named), F.lit(AFTER_ROLE))
    after: Column = F.lit(END)
    for name, (opens, closes) in AROUND.items():
        before, after = F.when(named == name, opens).otherwise(before), F.when(named == name, closes).otherwise(after)
    started = turns.select("*", before.alias("__before"), after.alias("__after"), visited.alias("__parts"))

    def further(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part["content"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        under = (part["kind"] == "text") & (F.col(role) == "assistant")
        spans = F.when(under, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.length("__before").cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))
    placed = F.filter(F.col("__parts"), lambda p: p["kind"] != "text")
    content = F.array_join(F.transform("__parts", lambda p: p["content"]), "")
    return started.select(
        *turns.columns,
        F.concat("__before", content, "__after").alias("formatted"),
        F.aggregate("__parts", start, further, lambda state: state["spans"]).alias("loss"),
        F.transform(placed, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
    )


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    order: Sequence[str] = ("turn",),
    role: str = "role",
    parts: str = "parts",
    visitor: Visitor | None = None,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Formatted conversations in chunks of whole turns, adjacent and in order: `conv_id`, `chunk` (from 0),
    `formatted`, `n_turns`, the spans under the `loss` mask and the `attachments` with their expanded tokens.

    Turns follow `order`, null first, then role and formatted text, so ties have one result; repeated rows are turns
    of their own. `parts` is an array of `PART`. A null role is an empty one, null or empty parts are an empty text,
    a null id is a conversation like any other. A chunk ends after the turn that brings it to `chunk_chars`, so a very
    long turn is in one chunk. Other columns are left out, so clashing names do no harm. An empty table gives no chunks.
    """
    kind = dict(turns.select(F.col(conv).alias("c")).dtypes)["c"]
    columns = [
        F.col(conv).alias("conv_id"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.col(parts).alias("parts"),
    ]
    done = format_turns(turns.select(*columns), "role", "parts", visitor or Visitor())
    keys = [f"o{i}" for i in range(len(order))]
    ordered = in_order(done.drop("parts"), ["conv_id"], [*keys, "role", "formatted"])

    def chunks(rows: Rows) -> Iterator[tuple]:
        for name, held in groupby(rows, itemgetter(0)):
            number = at = size = 0
            texts, loss, attached = [], [], []
            for _, text, spans, placed in held:
                texts.append(text)
                loss += [{"start": at + s["start"], "end": at + s["end"]} for s in spans]
                attached += placed
                at, size = at + len(text), size + len(text)
                if size >= chunk_chars:
                    yield name, number, "".join(texts), len(texts), loss, attached
                    number, size, texts, loss, attached = number + 1, 0, [], [], []
            if texts:
                yield name, number, "".join(texts), len(texts), loss, attached

    arrow = pa.schema(
        [("conv_id", _ARROW[kind]), ("chunk", pa.int32()), ("formatted", pa.string()), ("n_turns", pa.int32()), ("loss", _SPAN), ("attachments", _ATTACHMENT)]
    )
    return stream(ordered.select("conv_id", "formatted", "loss", "attachments"), chunks, arrow, _CHUNKS.format(kind=kind))


def parsed(formatted: str, refs: Iterator[dict]) -> Iterator[tuple[str, list[tuple[str, str, str | None]]]]:
    """Role and parts (kind, text, reference) of each turn; texts side by side come back as one."""
    at = 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            raise ValueError(f"no turn at {at}")
        at = turn.end()
        role = "user" if turn["user"] is not None else "assistant" if turn["assistant"] is not None else unescaped(turn["role"])
        content = next(turn[g] for g in ("user", "assistant", "other") if turn[g] is not None)
        parts, begun = [], 0
        for mark in _PLACEHOLDER.finditer(content):
            if mark.start() > begun:
                parts.append(("text", unescaped(content[begun : mark.start()]), None))
            parts.append((_KINDS[mark[0]], "", next(refs)["ref"]))
            begun = mark.end()
        if begun < len(content) or not parts:
            parts.append(("text", unescaped(content[begun:]), None))
        yield role, parts
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


def read_turns(chunks: DataFrame, ordered: bool = False) -> DataFrame:
    """The turns of formatted conversations: `conv_id`, `place` (from 0), `role`, `parts` (kind, text, ref).

    `ordered=True` takes chunks as `format_conversations` leaves them; stored ones have to be sorted again.
    """
    kind = dict(chunks.dtypes)["conv_id"]

    def turns(rows: Rows) -> Iterator[tuple]:
        for name, held in groupby(rows, itemgetter(0)):
            place = 0
            for _, formatted, attached in held:
                for role, parts in parsed(formatted, iter(attached)):
                    yield name, place, role, [dict(zip(("kind", "text", "ref"), p, strict=True)) for p in parts]
                    place += 1

    part = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))
    arrow = pa.schema([("conv_id", _ARROW[kind]), ("place", pa.int64()), ("role", pa.string()), ("parts", part)])
    rows = chunks if ordered else in_order(chunks, ["conv_id"], ["chunk"])
    shape = f"conv_id {kind}, place bigint, role string, parts array<struct<kind: string, text: string, ref: string>>"
    return stream(rows.select("conv_id", "formatted", "attachments"), turns, arrow, shape)


def digests(chunks: DataFrame, ordered: bool = False) -> DataFrame:
    """What is read back from formatted conversations, in one row each: `n_turns`, `turns_sha256` (role, line feed,
    text, line feed for each turn), `loss_chars` and `loss_sha256` (the text under the loss mask, unescaped),
    `formatted_chars`, `n_attachments`, `attachment_tokens`. See `read_turns` for `ordered`."""
    kind = dict(chunks.dtypes)["conv_id"]

    def summed(rows: Rows) -> Iterator[tuple]:
        for name, held in groupby(rows, itemgetter(0)):
            every, under = hashlib.sha256(), hashlib.sha256()
            turns = loss = chars = placed = tokens = 0
            for _, formatted, spans, attached in held:
                for role, parts in parsed(formatted, iter(attached)):
                    every.update(f"{role}\n{''.join(text for _, text, _ in parts)}\n".encode())
                    turns += 1
                for span in spans:
                    text = unescaped(formatted[span["start"] - chars : span["end"] - chars])
                    under.update(text.encode())
                    loss += len(text)
                chars += len(formatted)
                placed, tokens = placed + len(attached), tokens + sum(a["tokens"] for a in attached)
            yield name, turns, every.hexdigest(), loss, under.hexdigest(), chars, placed, tokens

    names = "n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_attachments attachment_tokens".split()
    types = ["string" if n.endswith("sha256") else "bigint" for n in names]
    arrow = pa.schema([("conv_id", _ARROW[kind]), *[(n, _ARROW[t]) for n, t in zip(names, types, strict=True)]])
    rows = chunks if ordered else in_order(chunks, ["conv_id"], ["chunk"])
    shape = ", ".join([f"conv_id {kind}", *[f"{n} {t}" for n, t in zip(names, types, strict=True)]])
    return stream(rows.select("conv_id", "formatted", "loss", "attachments"), summed, arrow, shape)
