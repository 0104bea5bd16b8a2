"""Chat formatting: a finite-state machine over roles checks the order of turns and emits text segments with a loss flag.

A ``Template`` declares how turns are marked, which roles carry loss and which role may follow which. Texts are escaped
reversibly: a backslash stands before every control string and before every backslash of a text, so no text can open or
close a turn.

Turns of a conversation are in order of (turn, role, text). Rows are dealt out by conversation and sorted; segments are
emitted as a stream, so a conversation of any length needs the memory of one turn. The digests of one conversation are
chains over its turns, which one task has to follow; everything before them is per turn.

Defined results: a null text or role is empty; a null turn comes first; rows with a null conv_id are one conversation with a
null id; repeated rows are turns of their own; a conversation that breaks the order of roles is formatted all the same and
has ``valid`` = false; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """``open`` has ``{role}``; a turn is open + text + close. ``follows``: the roles that may come after a role; "" starts,
    and ``final`` are the roles that may end a conversation."""

    open: str = "### {role}: "
    close: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", *self.controls))), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def escape_role(self, role: str) -> str:
        return re.sub(r"[\\:\n#<]", lambda m: "\\" + m[0], role)

    def step(self, state: str | None, role: str) -> str | None:
        """The state after a turn of ``role``; None once the order is broken."""
        return role if state is not None and role in self.follows.get(state, ()) else None


DEFAULT = Template()
_SEGMENT = "conv_id long, turn long, part int, segment string, loss boolean, valid boolean"


def _segments(batches, template: Template):
    """Sorted turns -> three segments a turn: opening, escaped text, closing. ``valid``: the order holds so far."""
    conv, state = object(), None
    for batch in batches:
        out = []
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv_id != conv:
                conv, state = conv_id, ""
            role = role or ""
            state = template.step(state, role)
            valid = state is not None
            out.append((conv_id, turn, 0, template.open.format(role=template.escape_role(role)), False, valid))
            out.append((conv_id, turn, 1, template.escape(text or ""), role in template.loss_roles, valid))
            out.append((conv_id, turn, 2, template.close, False, valid))
        columns = [*zip(*out)] or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "part", "segment", "loss", "valid"])


def chat_segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, part, segment, loss, valid), in order within each conversation; the segments of a conversation, one
    after the other, are its formatted text, and ``loss`` marks those that are trained on."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda b: _segments(b, template), _SEGMENT)


class _Reader:
    """Reads one conversation back from its formatted text and loss mask, turn by turn, and keeps digests only."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        head, tail = map(re.escape, template.open.split("{role}"))
        self.turn = re.compile(rf"{head}((?:[^\\:\n#<]|\\.)*){tail}((?:[^\\]|\\.)*?){re.escape(template.close)}", re.S)
        self.turns, self.loss_chars, self.chars, self.last, self.valid = 0, 0, 0, "", True
        self.text, self.masked = "", []
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, segment: str, loss: bool, valid: bool) -> None:
        self.chars += len(segment)
        self.valid &= valid
        if loss:
            self.masked.append(segment)
        self.text += segment
        if not self.text.endswith(self.template.close) or not (m := self.turn.match(self.text)):
            return
        self.last, text = map(self.template.unescape, m.groups())
        self.all.update(f"{self.last}\n{text}\n".encode())
        self.turns += 1
        for part in map(self.template.unescape, self.masked):
            self.loss_chars += len(part)
            self.loss.update(part.encode())
        self.text, self.masked = self.text[m.end() :], []

    def row(self):
        if self.text:
            raise ValueError(f"conversation {self.conv_id}: what follows turn {self.turns} is no turn")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in self.template.final


def _digests(batches, template: Template):
    reader = None
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def out(rows):
        columns = [*zip(*rows)] or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    for batch in batches:
        done = []
        for conv_id, segment, loss, valid in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss", "valid"))):
            if reader is None or reader.conv_id != conv_id:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv_id, template)
            reader.read(segment, loss, valid)
        yield out(done)
    if reader:
        yield out([reader.row()])


def chat_digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, read back from its segments: conv_id, n_turns, turns_sha256 (role, newline, text, newline
    of each turn), loss_chars, loss_sha256 (all text under the loss mask), formatted_chars, valid."""
    return chat_segments(turns, template).mapInArrow(lambda b: _digests(b, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def hostile_turns(spark) -> DataFrame:
    """Conversation -7: turns whose texts imitate the template."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
