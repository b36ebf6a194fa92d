"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn into one string: texts escaped, image,
audio and document parts as placeholders, in order.  Each attachment's
reference, place and expanded token count are recorded beside the string.

Template: ``[TURN role]`` content ``[/TURN]`` and a line break; placeholders are
``[IMAGE]``, ``[AUDIO]``, ``[DOCUMENT]`` and ``[ATTACHMENT]``.  Inside texts and roles a
backslash goes before each backslash, bracket and ``<``, so neither this template's
marks nor common control strings such as ``</s>`` or ``[INST]`` can appear there,
and removing those backslashes gives the text back.

Turns are formatted in parallel.  Conversations are then put together by
streaming over the turns sorted by conversation and turn: output goes out in
pieces of whole turns, so a conversation of any length needs the memory of
one piece only.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<turn: long, type: string, ref: string, at: long, n_tokens: long>"
_ATTACHMENT = pa.struct([("turn", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])
SPAN = "struct<start: long, end: long>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])

_SPECIAL = re.compile(r"[\\\[\]<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLAIN = r"[^\\\[\]<]*(?:\\.[^\\\[\]<]*)*"
_TURN = re.compile(rf"\[TURN ({_PLAIN})\]((?:{_PLAIN}\[(?:IMAGE|AUDIO|DOCUMENT|ATTACHMENT)\])*{_PLAIN})\[/TURN\]\n", re.S)
_PLACEHOLDER = re.compile(rf"({_PLAIN})(?:\[(?:IMAGE|AUDIO|DOCUMENT|ATTACHMENT)\])?", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class FlattenParts:
    """Visitor over the content parts of one turn.

    ``spans`` are the places of text parts in the flattened content, and
    ``attachments`` the places, references and expanded token counts of the
    others.  Missing sizes count as one patch, second or page.
    """

    PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{(part['type'] or 'text').lower()}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        self.spans.append((self.at, self.at + len(text)))
        self._add(text)

    def visit_image(self, part: dict) -> None:
        patches = [max(1, math.ceil((part[side] or 1) / self.PATCH)) for side in ("width", "height")]
        self._attach("IMAGE", part, patches[0] * patches[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("AUDIO", part, max(1, math.ceil((part["seconds"] or 1) * self.TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("DOCUMENT", part, max(1, part["pages"] or 1) * self.TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach("ATTACHMENT", part, 1)

    def _attach(self, name: str, part: dict, n_tokens: int) -> None:
        self.attachments.append({"type": part["type"], "ref": part["ref"], "at": self.at, "n_tokens": n_tokens})
        self._add(f"[{name}]")

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def format_turn(turn: int | None, role: str | None, parts: list[dict], loss_roles: tuple[str, ...]):
    """The formatted turn, its loss spans and its attachments; places count from the turn's start."""
    flat = FlattenParts()
    for part in parts:
        flat.visit(part)
    head = f"[TURN {escape(role or '')}]"
    spans = [(len(head) + s, len(head) + e) for s, e in flat.spans if e > s] if role in loss_roles else []
    attached = [a | {"turn": turn, "at": a["at"] + len(head)} for a in flat.attachments]
    return f"{head}{''.join(flat.out)}[/TURN]\n", spans, attached


def _format(loss_roles: tuple[str, ...]):
    def run(batches):
        for b in common.slices(batches):
            out = [format_turn(r["turn"], r["role"], r["parts"] if r["parts"] is not None else
                               [{"type": "text", "text": r["text"]}], loss_roles) for r in b.to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in x[1]] for x in out]
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["turn"], b["role"], b["text"], pa.array([x[0] for x in out]),
                 pa.array(spans, pa.list_(_SPAN)), pa.array([x[2] for x in out], pa.list_(_ATTACHMENT))],
                names=["conv_id", "turn", "role", "text", "formatted", "loss", "attachments"])
    return run


def _assemble(piece_chars: int):
    def run(batches):
        types = {"conv_id": pa.int64(), "piece_no": pa.int32(), "n_turns": pa.int32(), "formatted": pa.string(),
                 "loss": pa.list_(_SPAN), "attachments": pa.list_(_ATTACHMENT)}
        conv, no, turns, size, texts, loss, attached = None, -1, 0, 0, [], [], []

        def piece():
            return common.batch({"conv_id": [conv], "piece_no": [no], "n_turns": [turns], "formatted": ["".join(texts)],
                                 "loss": [loss], "attachments": [attached]}, types)
        for b in common.slices(batches):
            for r in b.to_pylist():
                if turns and (r["conv_id"] != conv or size >= piece_chars):
                    yield piece()
                    turns, size, texts, loss, attached = 0, 0, [], [], []
                    no = no + 1 if r["conv_id"] == conv else 0
                elif not turns:
                    no = 0
                conv = r["conv_id"]
                loss += [{"start": size + s["start"], "end": size + s["end"]} for s in r["loss"]]
                attached += [a | {"at": size + a["at"]} for a in r["attachments"]]
                texts.append(r["formatted"])
                size += len(r["formatted"])
                turns += 1
        if turns:
            yield piece()
    return run


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), piece_chars: int = 65_536) -> DataFrame:
    """``conv_id, piece_no, n_turns, formatted, loss, attachments``: the formatted conversations.

    ``turns`` has ``conv_id, turn, role, text`` and may have ``parts``, an array of
    :data:`PART`; a turn without parts has its text as its only part.  A
    conversation is one piece unless it is longer than ``piece_chars``; pieces
    hold whole turns, and their places count from the piece's start.

    Null text: empty; null role: the empty role; null conversation ids: one
    conversation; null turns come first.  Turns with equal numbers are ordered
    by role, then text; repeated rows are turns like any other.
    """
    parts = turns["parts"].cast(f"array<{PART}>") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"),
                        turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"), parts.alias("parts"))
    formatted = common.map_arrow(
        rows, _format(loss_roles),
        f"conv_id long, turn long, role string, text string, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>")
    ordered = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return common.map_arrow(
        ordered.drop("role", "text", "turn"), _assemble(piece_chars),
        f"conv_id long, piece_no int, n_turns int, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted piece, unescaped and without placeholders."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        turns.append((unescape(m[1]), "".join(unescape(x) for x in _PLACEHOLDER.findall(m[2]))))
        at = m.end()
    return turns


def _read_back(batches):
    """Streams over pieces in order; the digests of a conversation go on from piece to piece."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    state = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], schema.field(n).type) for n, v in zip(
            names, [state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]], strict=True)], schema=schema)
    for b in batches:
        for conv, no, text, loss in zip(*[b[c] for c in ("conv_id", "piece_no", "formatted", "loss")], strict=True):
            conv, text = conv.as_py(), text.as_py()
            if no.as_py() == 0:
                if state:
                    yield row()
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            for role, said in parse(text):
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["n"] += 1
            for span in loss.as_py():
                said = unescape(text[span["start"]:span["end"]])
                state["loss"].update(said.encode())
                state["chars"] += len(said)
            state["size"] += len(text)
    if state:
        yield row()


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say, read back from them.

    ``formatted`` must come straight from :func:`format_conversations`, whose
    partitions hold conversations whole and in order.
    """
    return common.map_arrow(formatted, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
                                                   " loss_sha256 string, formatted_chars long")
