"""Chat formatting: a finite-state machine over roles checks the order of the turns, and a declarative
template turns each turn into text segments with a loss flag each.

The turns of a conversation are brought together and sorted, then read as a stream: a task holds one
batch of turns and a few numbers of the conversation that it is in, however long that is. The output
is one row a turn, so no conversation is ever gathered in a row.

Control strings inside texts are escaped by one backslash after their first character, and a backslash
more where there are some already: what is read back is the text as it was, whatever it held.

Defined results: a null text counts as empty; a null role is the role of no letters; null conversation
ids make one conversation. Roles that the template doesn't know keep their name in the output, in the
template's part for others; the machine calls such a conversation invalid, as it does with any order
it has no step for, but its turns are formatted all the same. Turns are ordered by number (null
first), ties by role and text; repeated rows are turns of their own. Texts of any length are taken
whole. An empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A piece of a formatted turn: a mark as it stands, or the turn's ``role`` or ``text``."""

    kind: str
    mark: str = ""
    loss: bool = False


def mark(text: str) -> Part:
    return Part("mark", text)


TEXT, LEARNED_TEXT, ROLE = Part("text"), Part("text", loss=True), Part("role")


@dataclass(frozen=True)
class Template:
    """The parts of a turn for each role, and for roles that are not among them. Marks are control
    strings; each begins and ends with a bracket, and none begins inside another."""

    parts: dict[str, tuple[Part, ...]]
    others: tuple[Part, ...]
    reserved: tuple[str, ...] = ()

    def of(self, role: str) -> tuple[Part, ...]:
        return self.parts.get(role, self.others)

    def controls(self) -> list[str]:
        own = {p.mark for parts in (*self.parts.values(), self.others) for p in parts if p.kind == "mark"}
        return sorted(own | set(self.reserved))


@dataclass(frozen=True)
class Machine:
    """States, and the step that each role makes from each; what has no step leads to ``bad`` for good."""

    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=dict)
    final: frozenset[str] = frozenset()
    bad: str = "bad"

    def after(self, state: str, role: str) -> str:
        return self.steps.get((state, role), self.bad)


DEFAULT = Template(
    parts={
        "system": (mark("<<SYS>>"), TEXT, mark("<</SYS>>")),
        "user": (mark("[INST]"), TEXT, mark("[/INST]")),
        "assistant": (mark("<s>"), LEARNED_TEXT, mark("</s>")),
    },
    others=(mark("[ROLE]"), ROLE, mark("[SAYS]"), TEXT, mark("[/ROLE]")),
)

#: An optional system turn, then user and assistant by turns, the assistant last.
TURN_ORDER = Machine(
    steps={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=frozenset({"assistant"}),
)


class Escapes:
    """Escaping and its reverse, for the control strings of a template."""

    def __init__(self, template: Template):
        names = template.controls()
        inside = "|".join(f"(?<={re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in names)
        self._plain = re.compile(inside)
        self._escaped = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in names))

    def put(self, text: str) -> str:
        return self._plain.sub(lambda m: m.group() + "\\", text)

    def take(self, text: str) -> str:
        return self._escaped.sub("", text)


SEGMENTS = "array<struct<text: string, loss: boolean>>"
KEYS = ("conv_id", "turn", "role", "text")


def arranged(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of each conversation in one task and in order, ready to be read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def formatted(turns: DataFrame, template: Template = DEFAULT, machine: Machine = TURN_ORDER, columns: tuple[str, str, str, str] = KEYS) -> DataFrame:
    """One row a turn, in order within its partition: conv_id, turn, place (from 0), role, state (of
    the machine after this turn), valid (no bad step so far) and the segments."""
    conv, turn, role, text = columns
    blank = F.lit("")
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text")
    )
    segment = pa.struct([("text", pa.string()), ("loss", pa.bool_())])

    def run(batches):
        escapes = Escapes(template)
        conv, state, place, begun = None, machine.start, 0, False
        for b in batches:
            out = {"place": [], "state": [], "valid": [], "segments": []}
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not begun or c != conv:
                    conv, state, place, begun = c, machine.start, 0, True
                state = machine.after(state, r)
                out["place"].append(place)
                out["state"].append(state)
                out["valid"].append(state != machine.bad)
                said = {"mark": None, "role": escapes.put(r), "text": escapes.put(t)}
                out["segments"].append([{"text": p.mark if p.kind == "mark" else said[p.kind], "loss": p.loss} for p in template.of(r)])
                place += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out["place"], pa.int64()), b.column(2), pa.array(out["state"], pa.string()), pa.array(out["valid"], pa.bool_()), pa.array(out["segments"], pa.list_(segment))],
                names=["conv_id", "turn", "place", "role", "state", "valid", "segments"],
            )

    return arranged(rows, "turn", "role", "text").mapInArrow(run, f"conv_id long, turn long, place long, role string, state string, valid boolean, segments {SEGMENTS}")


class Reader:
    """Reads a formatted turn back: its role and its text, from the formatted text alone."""

    def __init__(self, template: Template):
        self._escapes = Escapes(template)
        self._known = [(role, self._pattern(parts)) for role, parts in template.parts.items()] + [(None, self._pattern(template.others))]

    @staticmethod
    def _pattern(parts: tuple[Part, ...]) -> re.Pattern:
        return re.compile("".join(re.escape(p.mark) if p.kind == "mark" else f"(?P<{p.kind}>.*?)" for p in parts) + r"\Z", re.S)

    def turn(self, text: str) -> tuple[str, str]:
        for role, pattern in self._known:
            if found := pattern.match(text):
                return role if role is not None else self.plain(found["role"]), self.plain(found["text"])
        raise ValueError("text that no part of the template has made")

    def plain(self, text: str) -> str:
        return self._escapes.take(text)


def read_back(output: DataFrame, template: Template = DEFAULT, machine: Machine = TURN_ORDER, in_order: bool = False) -> DataFrame:
    """What the formatted output says of each conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, ``valid`` (the machine took every turn and stands in a
    final state). Only the segments are read, no column that was merely carried along, but for the
    state. ``in_order``: the rows come straight from ``formatted``, in the same plan."""
    rows = (output if in_order else arranged(output, "place")).select("conv_id", "state", "segments")

    def run(batches):
        reader = Reader(template)
        waiting: list[dict] = []
        open_: dict | None = None

        def closed(one: dict) -> dict:
            return one | {"turns_sha256": one["turns_sha256"].hexdigest(), "loss_sha256": one["loss_sha256"].hexdigest()}

        def rows_of(found: list[dict]) -> pa.RecordBatch:
            kinds = {"conv_id": pa.int64(), "turns_sha256": pa.string(), "loss_sha256": pa.string(), "valid": pa.bool_()}
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds.get(k, pa.int64())) for k in names], names=list(names))

        for b in batches:
            lists = b.column(2)
            texts, flags = lists.flatten().field(0).to_pylist(), lists.flatten().field(1).to_pylist()
            at = 0
            for c, state, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists.value_lengths().to_pylist()):
                if open_ is None or c != open_["conv_id"]:
                    if open_ is not None:
                        waiting.append(closed(open_))
                    open_ = {"conv_id": c, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "valid": False}
                whole = "".join(texts[at : at + n])
                role, text = reader.turn(whole)
                open_["n_turns"] += 1
                open_["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for k in range(at, at + n):
                    if flags[k]:
                        said = reader.plain(texts[k])
                        open_["loss_chars"] += len(said)
                        open_["loss_sha256"].update(said.encode())
                open_["formatted_chars"] += len(whole)
                open_["valid"] = state in machine.final
                at += n
            if waiting:
                yield rows_of(waiting)
                waiting = []
        if open_ is not None:
            yield rows_of([closed(open_)])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
