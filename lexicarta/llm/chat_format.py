"""Chat formatting with a state machine over roles and a declarative template.

Every turn becomes three segments: its opening mark, its text, its closing mark. The
segments of a conversation, in order, are its formatted text; those whose ``loss`` is
set are what a model is trained to say. A state machine follows the roles and tells
after each turn whether the order so far is valid; conversations with an invalid order
are formatted all the same.

Control strings inside texts are broken up by a backslash after their first character,
and backslashes are doubled, so that a text never holds a mark and comes back unchanged.

Turns stream through in order, so that a conversation of any length takes the memory of
one turn. Defined results: null roles and texts are empty; null turns come first;
equal turns are ordered by role and text; null ``conv_id`` are one conversation. Roles without a
place in the template are written with their name and make the order invalid. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import only


@dataclass(frozen=True)
class Template:
    """Marks of roles, the roles under the loss mask, and the allowed order of roles."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS] "),
            "user": ("[INST] ", " [/INST] "),
            "assistant": ("[SAY] ", "</s>"),
        }
    )
    #: Opening mark of other roles, what follows their name, and their closing mark.
    other: tuple[str, str, str] = ("[ROLE] ", " [AS] ", " [/ROLE] ")
    loss: frozenset[str] = frozenset({"assistant"})
    #: State and role to next state; what is missing leads to ``invalid`` for good.
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    complete: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        """Strings that no text may hold: all marks without the spaces around them."""
        every = [self.begin, *(m for pair in self.marks.values() for m in pair), *self.other]
        return sorted({m.strip() for m in every}, key=lambda c: (-len(c), c))


DEFAULT = Template()


def escaper(template: Template) -> re.Pattern:
    return re.compile("|".join(map(re.escape, ["\\", *template.controls()])))


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_segments(role: str, text: str, template: Template, pattern: re.Pattern) -> list[tuple[str, bool]]:
    """``(text, loss)`` of the three segments of a turn."""
    if role in template.marks:
        opening, closing = template.marks[role]
    else:
        before, after, closing = template.other
        opening = before + escape(role, pattern) + after
    return [(opening, False), (escape(text, pattern), role in template.loss), (closing, False)]


def read_turns(segments: Iterable[tuple[str, bool]], template: Template) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation, by its marks alone."""
    buffer, begun, searched = "", False, 0
    for text, _ in segments:
        buffer += text
        while True:
            if not begun:
                if not buffer.startswith(template.begin):
                    break
                buffer, begun, searched = buffer[len(template.begin) :], True, 0
            role = next((r for r, (opening, _) in template.marks.items() if buffer.startswith(opening)), None)
            if role is not None:
                opening, closing = template.marks[role]
                start = len(opening)
            elif buffer.startswith(template.other[0]) and template.other[1] in buffer:
                before, after, closing = template.other
                stop = buffer.index(after, len(before))
                role, start = unescape(buffer[len(before) : stop]), stop + len(after)
            else:
                break
            end = buffer.find(closing, max(start, searched))
            if end < 0:
                searched = max(start, len(buffer) - len(closing))
                break
            yield role, unescape(buffer[start:end])
            buffer, searched = buffer[end + len(closing) :], 0
    if buffer or not begun:
        raise ValueError("not a formatted conversation")


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def formatted(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``(conv_id, turn_no, segment, text, loss, state)``; the order is that of turn and segment.

    ``turn_no`` counts from 0. Segment 0 of turn 0 begins with the mark of the whole.
    """
    pattern = escaper(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, state = object(), 0, "start"
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if conv != current:
                    current, number, state = conv, 0, "start"
                state = template.order.get((state, role), "invalid")
                for k, (part, loss) in enumerate(turn_segments(role, text, template, pattern)):
                    if number == k == 0:
                        part = template.begin + part
                    for column, value in zip(columns, (conv, number, k, part, loss, state)):
                        column.append(value)
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "turn_no", "segment", "text", "loss", "state"],
            )

    rows = only(turns, conv_id="bigint", turn="bigint", role="string", text="string").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return _ordered(rows, "turn", "role", "text").mapInArrow(
        run, "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, state string"
    )


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What formatted conversations hold, read from their texts and loss flags.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)``:
    the digest of role, line feed, text and line feed of each turn, and of all text
    under the loss mask; ``valid`` if the roles come in an allowed and complete order.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss")))

        stream, done = rows(), []
        row = next(stream, None)
        while row is not None:
            conv = row[0]
            turns, loss = hashlib.sha256(), hashlib.sha256()
            count = {"turns": 0, "loss": 0, "all": 0}

            def own() -> Iterator[tuple[str, bool]]:
                nonlocal row
                while row is not None and row[0] == conv:
                    text, under_loss = row[1], row[2]
                    count["all"] += len(text)
                    if under_loss:
                        plain = unescape(text)
                        count["loss"] += len(plain)
                        loss.update(plain.encode())
                    row = next(stream, None)
                    yield text, under_loss

            state = "start"
            for role, text in read_turns(own(), template):
                count["turns"] += 1
                turns.update(f"{role}\n{text}\n".encode())
                state = template.order.get((state, role), "invalid")
            done.append(
                (conv, count["turns"], turns.hexdigest(), count["loss"], loss.hexdigest(), count["all"],
                 state in template.complete)
            )
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    plain = only(segments, conv_id="bigint", turn_no="bigint", segment="int", text="string", loss="boolean")
    return _ordered(plain, "turn_no", "segment").mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint, valid boolean",
    )
