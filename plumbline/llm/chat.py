"""Chat formatting with typed content parts.

A visitor flattens a message's parts in order: text as it is, each image, audio or document as a placeholder
with an attachment record (index, kind, reference, tokens it expands to). A conversation is then written in
one template

    ### role: body</turn>

with a backslash before every control string (and backslash) inside roles and texts, so that the turns can
be read back exactly. The loss mask covers the bodies of assistant turns.

Nulls: a null text is empty, a null role is empty, a null part is skipped. Rows are taken by turn, then role,
then text, nulls first; repeated rows are messages of their own. A null conv_id is one conversation of its own.
An empty table gives an empty result. Texts of any length are formatted whole: a conversation is one output row
and so is held by one task; its size is its own, not the table's. Columns besides conv_id, turn, role, text and
parts are ignored; a column `parts` of another type is ignored too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

PART_TYPE = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
LOSS_ROLE = "assistant"
HEAD, COLON, END = "### ", ": ", "</turn>\n"

_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|<\||: ")
_READ = re.compile(r"\\(?P<plain>\\|###|</turn>|<\||: )|(?P<end></turn>\n)|<\|(?P<kind>[a-z]+) (?P<index>\d+)\|>|(?P<colon>: )|(?P<head>### )", re.S)


@dataclass(frozen=True)
class ChatParams:
    #: Square image patches of this many pixels a side are one token each.
    patch: int = 28
    audio_tokens_a_second: float = 25.0
    tokens_a_page: int = 600


@dataclass
class Attachment:
    index: int
    kind: str
    ref: str
    tokens: int


@dataclass
class Flattener:
    """Visitor over the parts of one conversation; attachments are numbered through it."""

    params: ChatParams = ChatParams()
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, parts: list[dict | None]) -> list[str | Attachment]:
        """Text runs (neighbours joined) and attachments, in order."""
        out: list[str | Attachment] = []
        for part in parts:
            if part is None:
                continue
            made = getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_unknown)(part)
            if isinstance(made, str) and out and isinstance(out[-1], str):
                out[-1] += made
            else:
                out.append(made)
        return out

    def _attach(self, kind: str, part: dict, tokens: int) -> Attachment:
        made = Attachment(len(self.attachments), kind, part.get("ref") or "", tokens)
        self.attachments.append(made)
        return made

    def visit_text(self, part: dict) -> str:
        return part.get("text") or ""

    def visit_image(self, part: dict) -> Attachment:
        side = self.params.patch
        return self._attach("image", part, max(1, math.ceil((part.get("width") or 0) / side)) * max(1, math.ceil((part.get("height") or 0) / side)))

    def visit_audio(self, part: dict) -> Attachment:
        return self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.params.audio_tokens_a_second)))

    def visit_document(self, part: dict) -> Attachment:
        return self._attach("document", part, max(1, part.get("pages") or 0) * self.params.tokens_a_page)

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"unknown kind of content part: {part.get('kind')!r}")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def format_turns(turns: list[tuple[str, list[dict | None]]], params: ChatParams = ChatParams()) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """The formatted conversation, its loss mask as code point spans, its attachments."""
    visitor, out, at, mask = Flattener(params), [], 0, []
    for role, parts in turns:
        head = HEAD + escape(role, _ROLE_CONTROL) + COLON
        body = "".join(escape(x) if isinstance(x, str) else f"<|{x.kind} {x.index}|>" for x in visitor.visit(parts))
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask, visitor.attachments


def unescape(text: str) -> str:
    """The text of a masked span; placeholders stay as they are."""
    return _READ.sub(lambda m: m["plain"] if m["plain"] is not None else m[0], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the formatted string alone."""
    turns: list[tuple[str, str]] = []
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(HEAD)
        role, got = None, []
        for m in _READ.finditer(formatted, at):
            got.append(formatted[at : m.start()])
            at = m.end()
            if m["plain"] is not None:
                got.append(m["plain"])
            elif m["colon"] is not None and role is None:
                role, got = "".join(got), []
            elif m["end"] is not None:
                turns.append((role or "", "".join(got)))
                break
            else:
                got.append(m[0])
        else:
            raise ValueError("a turn doesn't end")
    return turns


def grouped(messages: DataFrame) -> DataFrame:
    """conv_id and its messages in order. A column `parts` of type array<PART_TYPE>, where there is one and it is
    not null, stands before `text`; a column of that name and another type is ignored."""
    nothing = F.lit(None).cast(f"array<{PART_TYPE}>")
    given = "parts" in messages.columns and messages.schema["parts"].dataType.simpleString() == messages.select(nothing.alias("p")).schema["p"].dataType.simpleString()
    parts = F.col("parts") if given else nothing
    row = F.struct("turn", "role", "text", parts.alias("parts"))
    return messages.select("conv_id", row.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def format_conversations(messages: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, formatted, mask (array of start, end), attachments, attachment_tokens."""
    attach(messages.sparkSession)
    kind = messages.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "formatted", "mask", "attachments", "attachment_tokens"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    item = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            made = []
            for row in rb.column(1):
                turns = [(m["role"] or "", m["parts"] if m["parts"] is not None else [{"kind": "text", "text": m["text"]}]) for m in row.as_py()]
                made.append(format_turns(turns, params))
            cols = [
                pa.array([m[0] for m in made], pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in m[1]] for m in made], span),
                pa.array([[vars(x) for x in m[2]] for m in made], item),
                pa.array([sum(x.tokens for x in m[2]) for m in made], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([rb.column(0), *cols], names=names)

    return grouped(messages).mapInArrow(run, f"conv_id {kind}, formatted string, mask array<struct<start: long, stop: long>>, attachments array<struct<index: int, kind: string, ref: string, tokens: long>>, attachment_tokens long")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all from formatted and mask."""
    attach(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for text, mask in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
