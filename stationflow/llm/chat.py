"""Conversations as training text, with typed content parts, a loss mask and a way back.

A visitor goes over the parts of a message. Text parts are escaped; image, audio and document parts leave one placeholder each
and an attachment record (kind, reference, place, and the tokens the placeholder stands for once it is expanded). The
segment of a message is ``<|role|>role<|text|>body<|end|>``, and a formatted conversation is its segments in turn order.

Escaping puts one backslash behind the first character of whatever would read as a control string, any backslashes that
already stand there included; so no control string is left, texts without one are not touched, and taking one
backslash away again gives the text back.

Segments are made row by row, without a shuffle, and carry places within themselves: a conversation of any number of turns is
never one value. ``read_back`` deals segments by conversation and streams each in order through running digests. A digest
over a whole conversation is sequential by its nature, so a conversation that holds much of the table is one long task
there, in constant memory.

Edge cases: a NULL text or role is an empty one; a message without parts has an empty body; a part of unknown kind leaves a 'file'
placeholder, one of NULL kind is text if it has any. Rows of equal turn (repeated ones too) are all kept, ordered by their
segments; a NULL turn comes first; the rows of NULL conversation form one. An empty table gives no rows. Only the columns named
in the arguments are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose parts are Python objects at a time.
ROWS = 256

PARTS = (
    "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
)

# What is escaped in texts. The first character of each stands nowhere else in any of them.
OPENERS = r"[<\[]"
RESTS = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>"
CONTROL = rf"({OPENERS})(\\*)({RESTS})"
ESCAPED = rf"({OPENERS})\\(\\*)({RESTS})"
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
LEARNT = "assistant"

_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(ESCAPED)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|file)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


@dataclass(frozen=True)
class Expansion:
    """Tokens an attachment takes in the model's sequence; what a part does not tell counts as nothing."""

    image_patch: int = 14
    image_merge: int = 2
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 256

    def image(self, part: dict) -> int:
        side = self.image_patch * self.image_merge
        return math.ceil(max(part["width"] or 0, 0) / side) * math.ceil(max(part["height"] or 0, 0) / side)

    def audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return math.ceil(seconds * self.audio_tokens_a_second) if 0 < seconds < math.inf else 0

    def document(self, part: dict) -> int:
        return max(part["pages"] or 0, 0) * self.document_tokens_a_page


class Flattener:
    """Visitor over the parts of one message: its body so far and the attachments it met, in order."""

    def __init__(self, start: int, expansion: Expansion):
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.at = start
        self.expansion = expansion

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(part))

    def visit_other(self, part: dict) -> None:
        if part["kind"] is None and part["text"] is not None:
            self.visit_text(part)
        else:
            self._attach("file", part, 0)

    def _attach(self, mark: str, part: dict, tokens: int) -> None:
        self.attachments.append(
            {"ordinal": len(self.attachments), "kind": part["kind"], "uri": part["uri"], "start": self.at, "tokens": tokens}
        )
        self._put(f"<|{mark}|>")

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)


_ATTACHMENT = pa.struct(
    [("ordinal", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]
)
_SEGMENT = pa.struct(
    [
        ("segment", pa.string()), ("body_start", pa.int64()), ("body_end", pa.int64()), ("attachments", pa.list_(_ATTACHMENT)),
        ("expanded_tokens", pa.int64()),
    ]
)


def segment_of(role: str, parts: list[dict], expansion: Expansion = Expansion()) -> dict:
    head = f"{ROLE}{escape(role)}{TEXT}"
    flat = Flattener(len(head), expansion)
    for part in parts:
        flat.visit(part)
    return {
        "segment": "".join([head, *flat.pieces, END]),
        "body_start": len(head),
        "body_end": flat.at,
        "attachments": flat.attachments,
        "expanded_tokens": sum(a["tokens"] for a in flat.attachments),
    }


def parts_of_segment(segment: str, attachments: list[dict] = ()) -> tuple[str, list[dict]]:
    """Role and parts of a segment: text parts with their text, the others with the kind and reference of their attachment."""
    head, body = segment.removeprefix(ROLE).removesuffix(END).split(TEXT, 1)
    parts, at, known = [], 0, iter(attachments)
    for mark in _PLACEHOLDER.finditer(body):
        if mark.start() > at:
            parts.append({"kind": "text", "text": unescape(body[at : mark.start()])})
        found = next(known, {"kind": mark.group(1), "uri": None})
        parts.append({"kind": found["kind"], "uri": found["uri"]})
        at = mark.end()
    if at < len(body):
        parts.append({"kind": "text", "text": unescape(body[at:])})
    return unescape(head), parts


def text_parts(text: Column) -> Column:
    """A plain text as the one part of its message."""
    blank = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")]
    return F.array(F.struct(*fields, *[F.lit(None).cast(kind).alias(name) for name, kind in blank.items()]))


def formatted(
    messages: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", expansion: Expansion = Expansion()
) -> DataFrame:
    """(conv_id, turn, segment, learnt, body_start, body_end, attachments, expanded_tokens), one row per message.

    ``parts`` is a column of type ``PARTS``. The loss mask of a conversation is the bodies of its ``learnt`` rows; all places
    are code points within the segment.
    """

    def segments(roles: pa.Array, contents: pa.Array) -> pa.Array:
        made = []
        for first in range(0, len(roles), ROWS):
            pairs = zip(roles.slice(first, ROWS).to_pylist(), contents.slice(first, ROWS).to_pylist())
            made.append(pa.array([segment_of(r or "", p or [], expansion) for r, p in pairs], _SEGMENT))
        return pa.concat_arrays(made) if made else pa.array([], _SEGMENT)

    shape = (
        "segment string, body_start long, body_end long,"
        " attachments array<struct<ordinal:int,kind:string,uri:string,start:long,tokens:long>>, expanded_tokens long"
    )
    rows = messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role) == LEARNT, F.lit(False)).alias("learnt"),
        F.arrow_udf(segments, shape)(F.col(role), parts).alias("_made"),
    )
    return rows.select("conv_id", "turn", "learnt", "_made.*")


_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its segments alone: turns, digest of roles and texts, code points and digest of the text under
    the loss mask, and code points of the formatted conversation."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, n_turns, turns, n_loss, loss, n_chars = None, 0, None, 0, None, 0

        def close() -> None:
            if turns is not None:
                done.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))

        def given() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*done) if done else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                for row in batch.slice(first, ROWS).to_pylist():
                    if turns is None or row["conv_id"] != conv:
                        close()
                        conv, n_turns, n_loss, n_chars = row["conv_id"], 0, 0, 0
                        turns, loss = hashlib.sha256(), hashlib.sha256()
                    segment = row["segment"]
                    role, parts = parts_of_segment(segment)
                    n_turns += 1
                    n_chars += len(segment)
                    turns.update(f"{role}\n{''.join(p['text'] for p in parts if p['kind'] == 'text')}\n".encode())
                    if row["learnt"]:
                        learnt = unescape(_PLACEHOLDER.sub("", segment[row["body_start"] : row["body_end"]]))
                        n_loss += len(learnt)
                        loss.update(learnt.encode())
            yield given()
            done.clear()
        close()
        yield given()

    kept = segments.select("conv_id", "turn", "segment", "learnt", "body_start", "body_end")
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.drop("turn").mapInArrow(digests, _BACK)
