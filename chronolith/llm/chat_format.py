r"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine reads a conversation's turns in order and checks each role against the roles that may follow the last one; the
template gives, for each role, what stands before and after its text and whether the text counts for the loss. Output
is text segments with a loss flag each; joined in order they are the formatted conversation.

Control strings of the template start with `[` or `<`. In a text each of these two is followed by a backslash, and a
backslash is doubled, so that no control string can stand in a text and reading back is exact.

Conversations are streamed turn by turn in sorted order, so that one that holds a large share of all rows needs no more
memory than another.

Defined results: a null text or role counts as empty. Rows are ordered by turn (nulls first), then role and text, and repeated rows
are turns like others. Roles outside the template are formatted with their name and no loss, and make the
conversation invalid, like any role out of order or a last turn that the machine may not end on; invalid ones are still formatted.
Rows with a null conv_id are one conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """For each role (before, after, loss); the roles that may follow each state, where the states are the roles and the empty start."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    follow: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)
    other: tuple = ("[ROLE]", "[AS]", "[/ROLE]")


DEFAULT = Template()


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE * 2).replace("[", "[" + ESCAPE).replace("<", "<" + ESCAPE)


def unescape(text: str) -> str:
    return re.sub(r"([\[<\\])\\", r"\1", text)


def turn_segments(role: str, text: str, template: Template = DEFAULT) -> list[tuple[str, bool]]:
    """The segments of one turn, with their loss flags."""
    if role in template.roles:
        before, after, loss = template.roles[role]
        return [(before, False), (escape(text), loss), (after, False)]
    before, between, after = template.other
    return [(before + escape(role) + between, False), (escape(text), False), (after, False)]


def read_turn(text: str, template: Template = DEFAULT) -> tuple[str, str, int, int, int]:
    """(role, text, start and stop of the escaped text, end) of the turn at the start of a formatted text."""
    for role, (before, after, _) in template.roles.items():
        if text.startswith(before):
            stop = text.index(after, len(before))
            return role, unescape(text[len(before) : stop]), len(before), stop, stop + len(after)
    before, between, after = template.other
    if not text.startswith(before):
        raise ValueError("no turn starts here")
    at = text.index(between, len(before))
    stop = text.index(after, at + len(between))
    return unescape(text[len(before) : at]), unescape(text[at + len(between) : stop]), at + len(between), stop, stop + len(after)


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, started = None, "", 0, False
        for batch in batches:
            conv, role, text = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = [[], [], [], [], [], []]
            for c, r, t in zip(conv, role, text, strict=True):
                if not started or c != at:
                    at, state, n, started = c, "", 0, True
                fits = r in template.follow.get(state, ())
                for k, (piece, loss) in enumerate(turn_segments(r, t, template)):
                    for column, value in zip(out, (c, n, k, piece, loss, fits), strict=True):
                        column.append(value)
                state, n = r, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "turn_no", "part", "segment", "loss", "fits"])

    return run


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments in order: conv_id, turn_no (from 0), part (0 before, 1 text, 2 after), segment, loss, fits (role in its place)."""
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.col("turn").alias("turn"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(_formatter(template), "conv_id long, turn_no long, part int, segment string, loss boolean, fits boolean")


class _Reader:
    """Reads one formatted conversation, segment by segment, and takes its digests from the formatted text alone."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.lossy = template, "", []
        self.turns, self.chars, self.loss_chars, self.valid, self.role = 0, 0, 0, True, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, segment: str, loss: bool, fits: bool, last: bool) -> None:
        if loss:
            self.lossy.append((len(self.buffer), len(self.buffer) + len(segment)))
        self.buffer += segment
        self.chars += len(segment)
        self.valid &= fits
        if last:
            role, text, *_, end = read_turn(self.buffer, self.template)
            self.turns, self.role = self.turns + 1, role
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in self.lossy:
                under = unescape(self.buffer[a:b])
                self.loss_chars += len(under)
                self.loss.update(under.encode("utf-8", "surrogatepass"))
            self.buffer, self.lossy = self.buffer[end:], []

    def row(self, conv: int | None) -> tuple:
        if self.buffer:
            raise ValueError("text after the last turn")
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.role in self.template.ends


def _read_back(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        reader, at = None, None
        for batch in batches:
            done = []
            conv, _, part, segment, loss, fits = (batch.column(i).to_pylist() for i in range(6))
            for c, k, s, m, f in zip(conv, part, segment, loss, fits, strict=True):
                if reader is None or c != at:
                    if reader:
                        done.append(reader.row(at))
                    reader, at = _Reader(template), c
                reader.take(s, m, f, k == 2)
            if done:
                yield as_batch(done)
        if reader:
            yield as_batch([reader.row(at)])

    return run


def read_conversations(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, read back from the segments as `format_conversations` left them in their partitions."""
    return segments.mapInArrow(_read_back(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
