"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its markers and loss flag. Texts and
unknown role names are escaped, so that no control string of the template can
occur inside them; ``read_back`` undoes it. Turns stream in order through one
machine per conversation, so memory does not grow with its length.

Rows are sorted by turn (null first), then role, then text. Null texts and
roles are empty. Roles that the template lacks are marked by name. A
conversation whose roles break the order is formatted all the same and marked
invalid. Rows with a null conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = ("conv_id long, seq long, valid boolean, "
            "segments array<struct<text: string, loss: boolean>>")
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
           "loss_sha256 string, formatted_chars long, valid boolean")


@dataclass(frozen=True)
class Template:
    """Markers and loss by role, the marker of other roles, and the allowed turns.

    Every marker begins with a character that ``escape`` guards.
    """

    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("<s>[INST]", "[/INST]", False),
        "assistant": ("[ANS]", "</s>", True)})
    other: tuple = ("<<ROLE ", ">>", "<</ROLE>>")
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",)})
    final: tuple = ("user", "assistant")


def escape(text: str) -> str:
    """A backslash before each character that markers begin or end with, and before itself."""
    return re.sub(r"[\\<>\[]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Machine:
    """Walks over the roles of one conversation and emits each turn's segments."""

    def __init__(self, template: Template):
        self.template, self.state, self.valid, self.turns = template, "", True, 0

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        self.valid = self.valid and role in t.follows.get(self.state, ())
        self.state, self.turns = role, self.turns + 1
        if role in t.roles:
            opening, closing, loss = t.roles[role]
        else:
            opening, closing, loss = t.other[0] + escape(role) + t.other[1], t.other[2], False
        return [(opening, False), (escape(text), loss), (closing, False)]


def reader(template: Template):
    """A function that gives back (role, text) of every turn in a formatted text."""
    body = r"((?:[^\\<>\[]+|\\.)*+)"
    names, forms = list(template.roles), []
    for opening, closing, _ in template.roles.values():
        forms.append(re.escape(opening) + body + re.escape(closing))
    start, end, closing = map(re.escape, template.other)
    pattern = re.compile("|".join([*forms, start + body + end + body + closing]), re.S)

    def read(formatted: str):
        at = 0
        while at < len(formatted):
            found = pattern.match(formatted, at)
            if not found:
                raise ValueError(f"no turn begins at character {at}")
            at = found.end()
            which = found.lastindex - 1
            if which < len(names):
                yield names[which], unescape(found[which + 1])
            else:
                yield unescape(found[which]), unescape(found[which + 1])
    return read


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _format(template: Template):
    def run(batches):
        machine, current = None, object()
        for batch in batches:
            out = []
            for conv, role, text in _rows([batch]):
                if machine is None or conv != current:
                    machine, current = Machine(template), conv
                segments = machine.turn(role or "", text or "")
                out.append({"conv_id": conv, "seq": machine.turns - 1, "valid": machine.valid,
                            "segments": [{"text": s, "loss": x} for s, x in segments]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", pa.int64()), ("seq", pa.int64()), ("valid", pa.bool_()),
                ("segments", pa.list_(pa.struct([("text", pa.string()),
                                                 ("loss", pa.bool_())])))]))
    return run


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per turn, in order: its text segments, each with its loss flag.

    ``valid`` tells whether the roles up to this turn are in order.
    """
    return (conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_format(template), SEGMENTS))


def _digest(template: Template):
    def run(batches):
        read, state, current = reader(template), None, None

        def row():
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            return {"conv_id": current, "n_turns": state["n"], "turns_sha256": turns,
                    "loss_chars": state["loss_chars"], "loss_sha256": loss,
                    "formatted_chars": state["chars"],
                    "valid": state["valid"] and state["last"] in template.final}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                            ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("valid", pa.bool_())])
        for batch in batches:
            out = []
            for conv, _, valid, segments in _rows([batch]):
                if state is None or conv != current:
                    if state is not None:
                        out.append(row())
                    current = conv
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0,
                             "loss_chars": 0, "chars": 0, "valid": True, "last": ""}
                formatted = "".join(s["text"] for s in segments)
                state["chars"] += len(formatted)
                state["valid"] = valid
                for role, text in read(formatted):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                    state["last"] = role
                for part in segments:
                    if part["loss"]:
                        text = unescape(part["text"])
                        state["loss"].update(text.encode())
                        state["loss_chars"] += len(text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)
    return run


def conversation_digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what its formatted segments read back as.

    Takes the rows of ``format_conversations`` as they come, or a table of them
    dealt by conversation and sorted by ``seq``.
    """
    return segments.mapInArrow(_digest(template), DIGESTS)
