"""Chat formatting: a finite-state machine over roles and text segments with loss flags from a declarative template.

Turns of a conversation stream through a task in order (rows dealt by conversation, sorted by turn), so that neither a
long conversation nor a frequent one has to fit into memory.  The machine's state is the previous role; a transition that
the template does not list marks this turn and all later ones of the conversation as invalid, but they are formatted all
the same.

Escaping: the template's escape character doubles itself, and stands before every control string inside a text.  So a
control string that no escape character governs can come from the template only, and :func:`parse` recovers every text.

Null text: empty.  Null or unknown role: formatted under that name (null: empty name), invalid, without loss.  Null
conversation ids form one conversation.  Repeated rows are formatted each; rows with the same turn are ordered by role
and text.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

START, END = "start", "end"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles may follow which, and which roles' texts carry loss."""

    open_turn: str = "### "
    after_role: str = ": "
    close_turn: str = " </turn>\n"
    escape: str = "\\"
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        (START, ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that a text may not hold unescaped.
    controls: tuple[str, ...] = field(default=("### ", "</turn>"))

    def _pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(x) for x in (self.escape, *self.controls)))

    def escaped(self, text: str) -> str:
        return self._pattern().sub(lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + self._pattern().pattern + ")", lambda m: m[1], text)

    def name(self, role: str) -> str:
        return dict(self.names).get(role, "@" + self.escaped(role).replace(":", self.escape + ":"))

    def role(self, name: str) -> str:
        if name.startswith("@"):
            return self.unescaped(name[1:].replace(self.escape + ":", ":"))
        return {v: k for k, v in self.names}[name]


SEGMENTS = "conv_id {id}, turn long, place long, segment int, role string, text string, loss boolean, valid boolean"


def _machine(template: Template):
    """State per conversation: (last role, still valid)."""
    allowed = {k: set(v) for k, v in template.follows}

    def step(state: tuple[str, bool], role: str) -> tuple[str, bool]:
        last, valid = state
        return role, valid and role in allowed.get(last, ())

    return step


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order: for each turn the template's opening, the text and the closing, each with its loss flag.

    ``chats`` needs ``conv_id, turn, role, text``.  Concatenating a conversation's segments gives its formatted text.
    The rows of a conversation are contiguous and sorted within one partition; ``place`` numbers its turns as they come, so
    that the order can be found again.
    """
    prepare(chats.sparkSession)
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, state, last, fresh, place = _machine(template), (START, True), None, True, 0
        for b in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if fresh or conv != last:
                    state, last, fresh, place = (START, True), conv, False, 0
                role = role or ""
                state = step(state, role)
                loss = role in template.loss_roles
                head = template.open_turn + template.name(role) + template.after_role
                for k, (s, has_loss) in enumerate(((head, False), (template.escaped(text or ""), loss), (template.close_turn, False))):
                    out.append((conv, turn, place, k, role, s, has_loss, state[1]))
                place += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            types = [b.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "turn", "place", "segment", "role", "text", "loss", "valid"]
            )

    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartition(partitions(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS.format(id=kind))


class Reader:
    """Reads formatted text back, piece by piece; keeps digests and counts, not the conversation."""

    def __init__(self, template: Template):
        self.t = template
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss, self.valid = hashlib.sha256(), hashlib.sha256(), True
        self.held: list[tuple[str, bool]] = []

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        """One segment; a turn ends where the template's closing stands outside the text."""
        self.formatted_chars += len(text)
        self.valid &= valid
        self.held.append((text, loss))
        if loss:
            own = self.t.unescaped(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "replace"))
        if text == self.t.close_turn and len(self.held) >= 3:
            for role, own in parse("".join(s for s, _ in self.held), self.t):
                self.n_turns += 1
                self.turns.update(f"{role}\n{own}\n".encode("utf-8", "replace"))
            self.held = []


def parse(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text, found by the control strings alone."""
    t, at, turns = template, 0, []
    escaped = f"{re.escape(t.escape)}(?:{t._pattern().pattern}|:)|"
    name_end, turn_end = (re.compile(f"{escaped}({re.escape(x)})") for x in (t.after_role, t.close_turn))
    while at < len(formatted):
        if not formatted.startswith(t.open_turn, at):
            raise ValueError(f"no turn at {at}")
        start = at + len(t.open_turn)
        colon = next(m for m in name_end.finditer(formatted, start) if m[1])
        end = next(m for m in turn_end.finditer(formatted, colon.end()) if m[1])
        turns.append((t.role(formatted[start : colon.start()]), t.unescaped(formatted[colon.end() : end.start()])))
        at = end.end()
    return turns


DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """One row per conversation, from the segments of :func:`format_chats`, in whatever order: counts and digests of the
    turns and of the text under the loss mask, unescaped; and whether the turn order was valid.

    ``in_order``: they come straight from :func:`format_chats`, so that they need not be dealt and sorted again."""
    if not in_order:
        segments = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "segment")
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, arrow = None, None, None

        def row(r: Reader, conv) -> tuple:
            return conv, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars, r.valid

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            arrow, out = b.schema.field("conv_id").type, []
            for conv, text, loss, valid in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or conv != last:
                    if reader is not None:
                        out.append(row(reader, last))
                    reader, last = Reader(template), conv
                reader.feed(text, loss, valid)
            if out:
                yield batch(out)
        if reader is not None:
            yield batch([row(reader, last)])

    return segments.mapInArrow(run, DIGEST.format(id=kind))
