"""Chat formatting by a finite-state machine over roles.

A declarative template says how a turn is marked and which roles bear loss. The
machine checks the order of roles and turns each row into text segments with a
loss flag. Control strings inside texts are escaped reversibly: ``<``, any
backslashes and ``|`` get one more backslash, so ``<|`` never occurs in a text.

Rows are dealt by conversation and sorted by turn; machine and reader stream
over them, so a conversation of any length needs the memory of one turn.

Defined results: null text is empty text; a null role is the empty role, which
no state accepts; null turns come first; rows that share a turn are ordered by
role and text; rows without conv_id are one conversation; a conversation with
roles out of order is formatted all the same and reported as not valid; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import partitions, ship


@dataclass(frozen=True)
class Template:
    """Marks around a turn, loss roles and the machine's moves."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    #: Conversations may end in these states.
    final: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


CHATML = Template()
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape("".join(_ROLE.get(c, c) for c in role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_segments(role: str, text: str, template: Template = CHATML) -> list[tuple[str, bool]]:
    """(text, loss flag) for one turn."""
    return [(template.start + escape_role(role) + template.after_role, False), (escape(text), role in template.loss_roles), (template.end, False)]


class Machine:
    def __init__(self, template: Template = CHATML):
        self.template, self.state, self.valid = template, template.initial, True

    def step(self, role: str) -> None:
        to = self.template.moves.get((self.state, role))
        if to is None:
            self.valid = False
        else:
            self.state = to

    def accepted(self) -> bool:
        return self.valid and self.state in self.template.final


_SEGMENT = "conv_id long, segment long, text string, loss boolean, valid boolean"


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments in order: conv_id, segment (from 0), text, loss, and valid on
    the last segment (null on the others)."""

    def run(batches):
        conv, open_, machine, n, last = None, False, None, 0, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not open_ or c != conv:
                    if last is not None:
                        out.append((*last, machine.accepted()))
                    conv, open_, machine, n, last = c, True, Machine(template), 0, None
                machine.step(role or "")
                for seg, loss in turn_segments(role or "", text or "", template):
                    if last is not None:
                        out.append((*last, None))
                    last, n = (c, n, seg, loss), n + 1
            if out:
                yield _batch(out)
        if last is not None:
            yield _batch([(*last, machine.accepted())])

    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = ordered.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ship(rows.sparkSession)
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _SEGMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "segment", "text", "loss", "valid"])


class Reader:
    """Parses formatted text as it arrives and gathers a conversation's digests."""

    def __init__(self, template: Template = CHATML):
        self.template, self.text, self.mask = template, [], []
        self.turns, self.turn_hash = 0, hashlib.sha256()
        self.loss_chars, self.loss_hash, self.chars = 0, hashlib.sha256(), 0
        self.valid = False

    def feed(self, text: str, loss: bool, valid: bool | None) -> None:
        self.chars += len(text)
        self.text.append(text)
        if loss:
            self.mask.append(text)
        self.valid = self.valid or bool(valid)
        # A turn is whole once its end mark has come; texts can't hold one.
        if text.endswith(self.template.end):
            self._turn("".join(self.text), "".join(self.mask))
            self.text, self.mask = [], []

    def _turn(self, raw: str, mask: str) -> None:
        t = self.template
        if not raw.startswith(t.start) or raw.count(t.start) != 1 or raw.count(t.end) != 1:
            raise ValueError(f"not a turn: {raw[:80]!r}")
        role, found, text = raw[len(t.start) : -len(t.end)].partition(t.after_role)
        if not found:
            raise ValueError(f"a turn without a role: {raw[:80]!r}")
        self.turns += 1
        self.turn_hash.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        said = unescape(mask)
        self.loss_chars += len(said)
        self.loss_hash.update(said.encode())


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """A row per conversation, from ``format_conversations``' own output, whose
    partitions and order it keeps."""

    def run(batches):
        conv, reader = None, None

        def row():
            if reader.text:
                raise ValueError(f"conversation {conv} ends within a turn")
            return (conv, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars, reader.valid)

        for batch in batches:
            out = []
            for c, n, text, loss, valid in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "text", "loss", "valid")), strict=True):
                if reader is None or n == 0:
                    if reader is not None:
                        out.append(row())
                    conv, reader = c, Reader(template)
                reader.feed(text, loss, valid)
            if out:
                yield _read_batch(out)
        if reader is not None:
            yield _read_batch([row()])

    ship(segments.sparkSession)
    return segments.mapInArrow(run, _READ)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _READ.split(", ")])
