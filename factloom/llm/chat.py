"""Chat formatting of messages of typed content parts.

A message's text is a list of parts: plain text, or references ``![image: REF]``, ``![audio: REF SECONDS]`` and ``![document: REF PAGES]``
inside a text; a text that is a JSON array of ``{"type": ..., ...}`` objects is read as parts too. A visitor with one method per type flattens the parts, in
order, into the template: texts as they are, each attachment as a numbered placeholder, its reference recorded, and its *expanded* count, the
tokens for which the placeholder stands: fixed for an image, by seconds for audio, by pages for a document, by words for text.

Conversations are rendered turn by turn in order of ``turn``: ``<|role|>`` and the content, each ended by ``<|end|>``. Attachments are numbered through
the conversation. A null role is ``user``, a null text is empty; a null ``turn`` comes first; a null ``conv_id`` is one conversation. Ties of ``turn`` go by role and
text, and repeated rows are repeated messages. A part of unknown type, or one without what it needs, is kept as the text that it was, character by character; so is one
whose size is no number from 0 to ``MOST_SIZE``. Halves of surrogate pairs, which JSON can spell, become replacement characters. Nothing is left
out. Markers of the template that stand in a text are escaped, so that no text can end its turn. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE_TOKENS, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 256, 25, 512
#: Seconds or pages of one part at most.
MOST_SIZE = 10**9

_REFERENCE = re.compile(r"!\[(image|audio|document):[ ]*([^\]\s]+)(?:[ ]+([0-9]+(?:\.[0-9]+)?))?\]")
_MARKER = re.compile(r"<\|(?=[a-z_]+(?::[0-9]+)?\|>)")


_DECODER = json.JSONDecoder()
_BLANK = re.compile(r"[ \t\n\r]*")
_SURROGATE = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """``text`` as it can be encoded."""
    return _SURROGATE.sub("\ufffd", text)


def _listed(text: str) -> list[dict] | None:
    """The typed parts of a JSON array, each with the text that it was; None if it isn't one of such parts only."""
    at = _BLANK.match(text).end() + 1
    out = []
    try:
        while True:
            start = _BLANK.match(text, at).end()
            part, at = _DECODER.raw_decode(text, start)
            if not isinstance(part, dict) or not isinstance(part.get("type"), str):
                return None
            out.append(part | {"raw": text[start:at]})
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] == "]":
                return out if not text[at + 1 :].strip() else None
            if text[at : at + 1] != ",":
                return None
            at += 1
    except (ValueError, RecursionError):
        return None


def parts_of(text: str | None) -> list[dict]:
    """Typed parts of a message's text."""
    if not text:
        return []
    if text.lstrip(" \t\n\r").startswith("[") and (parts := _listed(text)):
        return parts
    out, at = [], 0
    for m in _REFERENCE.finditer(text):
        if m.start() > at:
            out.append({"type": "text", "text": text[at : m.start()]})
        out.append({"type": m[1], "ref": m[2], "size": float(m[3]) if m[3] else None, "raw": m[0]})
        at = m.end()
    if at < len(text):
        out.append({"type": "text", "text": text[at:]})
    return out


class Visitor:
    """Flattens parts; ``text`` is what they give, ``attachments`` what they refer to, ``tokens`` the expanded count."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['type']}", None) if part["type"] in ("text", "image", "audio", "document") else None
        if method is None or not method(part):
            self.visit_text({"text": part["raw"]})

    def visit_text(self, part: dict) -> bool:
        text = part.get("text")
        if not isinstance(text, str):
            return False
        self.pieces.append(_MARKER.sub("<\\|", _whole(text)))
        self.tokens += len(text.split())
        return True

    def visit_image(self, part: dict) -> bool:
        return self._attach("image", part, IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> bool:
        return self._attach("audio", part, self._sized(part, AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> bool:
        return self._attach("document", part, self._sized(part, DOCUMENT_TOKENS_PER_PAGE))

    def _sized(self, part: dict, rate: int) -> int | None:
        size = part.get("size")
        if size is None:
            size = 1
        if isinstance(size, bool) or not isinstance(size, (int, float)) or not 0 <= size <= MOST_SIZE:
            return None
        return max(1, math.ceil(size * rate))

    def _attach(self, kind: str, part: dict, tokens: int | None) -> bool:
        ref = part.get("ref")
        if not isinstance(ref, str) or not ref or tokens is None:
            return False
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "ref": _whole(ref), "tokens": tokens})
        self.pieces.append(f"<|{kind}:{number}|>")
        self.tokens += tokens
        return True


def render(messages: list[tuple[str | None, str | None]]) -> tuple[str, list[dict], int]:
    """The text of a conversation, its attachments, and its tokens, two for each message's markers."""
    visitor = Visitor()
    for role, text in messages:
        name = re.sub(r"[^a-z_]", "_", (role or "user").lower())
        visitor.pieces.append(f"<|{name}|>\n")
        for part in parts_of(text):
            visitor.visit(part)
        visitor.pieces.append("<|end|>\n")
        visitor.tokens += 2
    return "".join(visitor.pieces), visitor.attachments, visitor.tokens


_ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_OUT = pa.schema([("conv_id", pa.int64()), ("n_messages", pa.int32()), ("text", pa.string()), ("attachments", pa.list_(_ATTACHMENT)), ("n_tokens", pa.int64())])


def _format(batches):
    for batch in batches:
        out = [(len(m), *render([(x["role"], x["text"]) for x in m])) for m in batch.column(1).to_pylist()]
        columns = [batch.column(0), *(pa.array([row[k] for row in out], _OUT.field(k + 1).type) for k in range(4))]
        yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_messages, text, attachments, n_tokens)`` of every conversation."""
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("message"))
    gathered = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("message")).alias("messages"))
    return gathered.mapInArrow(_format, "conv_id long, n_messages int, text string, attachments array<struct<number: int, kind: string, ref: string, tokens: long>>, n_tokens long")
