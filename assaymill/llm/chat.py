"""Chat formatting over typed content parts.

A turn is a role and a list of parts: text, image, audio or document.  A visitor
flattens the parts into one string with ordered placeholders, and records each
attachment's reference and the tokens it expands to.  The template frames turns
as ``### role: text</turn>\\n``; control strings inside texts and roles are
escaped by a backslash, so every formatted conversation reads back exactly.  The
loss mask is a list of spans that cover the texts of assistant turns alone.

Turns are formatted row by row.  Where a whole conversation is wanted, turns are
sorted within their partition and folded as a stream: memory holds one turn and
running digests, however long a conversation is."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|<\||:)")
#: Tokens an attachment expands to: an image per 28 x 28 pixels, audio per
#: second, a document per page.
PIXELS, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Text:
    text: str

    def accept(self, visitor: "Flattener") -> None:
        visitor.text(self)


@dataclass
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: "Flattener") -> None:
        visitor.attach("image", self.ref, max(1, math.ceil(self.width / PIXELS) * math.ceil(self.height / PIXELS)))


@dataclass
class Audio:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: "Flattener") -> None:
        visitor.attach("audio", self.ref, max(1, math.ceil(self.seconds * PER_SECOND)))


@dataclass
class Document:
    ref: str
    pages: int = 1

    def accept(self, visitor: "Flattener") -> None:
        visitor.attach("document", self.ref, max(1, self.pages) * PER_PAGE)


@dataclass
class Flattener:
    """Visits parts in order; ``out`` is the escaped text with placeholders
    ``<|kind:n|>``, ``attachments`` their (n, kind, reference, tokens)."""

    out: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def text(self, part: Text) -> None:
        self.out.append(escape(part.text))

    def attach(self, kind: str, ref: str, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append((n, kind, ref, tokens))
        self.out.append(f"<|{kind}:{n}|>")


def part_of(row: dict) -> Text | Image | Audio | Document:
    """A part from a record with ``type`` and its fields; nulls are zeros, an
    unknown type is an error."""
    kind = row.get("type") or "text"
    if kind == "text":
        return Text(row.get("text") or "")
    if kind == "image":
        return Image(row.get("ref") or "", row.get("width") or 0, row.get("height") or 0)
    if kind == "audio":
        return Audio(row.get("ref") or "", row.get("seconds") or 0.0)
    if kind == "document":
        return Document(row.get("ref") or "", row.get("pages") or 1)
    raise ValueError(f"unknown part type {kind!r}")


@dataclass
class Turn:
    """A formatted turn: its frame and flattened text, the span of the text
    within it, whether the span is under the loss mask, and attachments."""

    formatted: str
    start: int
    length: int
    loss: bool
    attachments: list[tuple[int, str, str, int]]


def format_turn(role: str | None, parts: list) -> Turn:
    visitor = Flattener()
    for part in parts:
        part.accept(visitor)
    body = "".join(visitor.out)
    head = OPEN + escape(role or "").replace(":", "\\:") + MID
    return Turn(head + body + CLOSE, len(head), len(body), role == "assistant", visitor.attachments)


_MID = re.compile(r"(?:[^\\:]|\\(?:\\|###|</turn>|<\||:))*?: ", re.S)
_BODY = re.compile(r"(?:[^\\<]|\\(?:\\|###|</turn>|<\||:)|<(?!/turn>))*</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay as they are."""
    at, out = 0, []
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        head = _MID.match(formatted, at + len(OPEN))
        body = _end(formatted, head.end()) if head else -1
        if body < 0:
            raise ValueError(f"the turn at {at} doesn't end")
        out.append((unescape(head[0][: -len(MID)]), unescape(formatted[head.end() : body])))
        at = body + len(CLOSE)
    return out


def _end(formatted: str, at: int) -> int:
    """Where the frame's end mark stands, past escaped ones."""
    while True:
        found = formatted.find(CLOSE, at)
        if found < 0:
            return -1
        back = found
        while back > at and formatted[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        at = found + 1


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, formatted, start, length, loss,
    attachments, attachment_tokens``.  The content is a string (one text part;
    null is empty) or an array of ``PARTS`` records (null is no part)."""
    plain = turns.schema[content_col].dataType.simpleString() == "string"
    attached = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                format_turn(role, [Text(content or "")] if plain else [part_of(p) for p in content or [] if p is not None])
                for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t.formatted for t in made], pa.string()),
                    pa.array([t.start for t in made], pa.int64()),
                    pa.array([t.length for t in made], pa.int64()),
                    pa.array([t.loss for t in made], pa.bool_()),
                    pa.array([[dict(zip(("n", "kind", "ref", "tokens"), a)) for a in t.attachments] for t in made], attached),
                    pa.array([sum(a[3] for a in t.attachments) for t in made], pa.int64()),
                ],
                names=["conv", "turn", "formatted", "start", "length", "loss", "attachments", "attachment_tokens"],
            )

    rows = turns.select(q(conv_col).alias("conv"), q(turn_col).alias("turn"), q(role_col).cast("string"), q(content_col))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv", "turn")]
    schema = f"conv {kinds[0]}, turn {kinds[1]}, formatted string, start long, length long, loss boolean, attachments array<struct<n:int,kind:string,ref:string,tokens:long>>, attachment_tokens long"
    return rows.mapInArrow(run, schema)


@dataclass
class _Digest:
    """Running digests of one conversation, read back turn by turn."""

    turns: int = 0
    said: object = field(default_factory=hashlib.sha256)
    lost: object = field(default_factory=hashlib.sha256)
    loss_chars: int = 0
    chars: int = 0

    def add(self, formatted: str, start: int, length: int, loss: bool) -> None:
        for role, text in read_back(formatted):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss:
            text = unescape(formatted[start : start + length])
            self.lost.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)


def conversation_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``, read back from the formatted turns.

    Turns come by number, nulls first, ties by formatted text; repeated rows are
    turns of their own.  A null role is the empty role; a null conversation id
    is one conversation.  Empty input: empty output.  Other columns play no
    part."""
    made = format_turns(turns, conv_col, turn_col, role_col, content_col)
    ordered = made.select("conv", "turn", "formatted", "start", "length", "loss").repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_id, now, done = None, None, None, []

        def closed() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c) for c in columns[1:])], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            done.append((open_id, now.turns, now.said.hexdigest(), now.loss_chars, now.lost.hexdigest(), now.chars))

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, formatted, start, length, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if now is None or conv != open_id:
                    if now is not None:
                        close()
                    open_id, now = conv, _Digest()
                now.add(formatted, start, length, loss)
            if len(done) >= 1000:
                yield closed()
                done.clear()
        if now is not None:
            close()
        if done:
            yield closed()

    kind = made.schema["conv"].dataType.simpleString()
    out = ordered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
