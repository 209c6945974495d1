"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows of a conversation pass in order of turn through a machine whose states are
roles.  Every turn gives an opening, a content and a closing segment, each with
a loss flag.  Control strings inside texts are escaped so that the output can be
read back.  Conversations are streamed through one task each; nothing of them
is held but the machine's state, so a long one needs no more memory.

Edge cases: a null text is an empty one, a null role is an empty role.  Turns
out of order are formatted like others and flagged; the machine then goes on
from the role that it met.  Rows with equal turns follow by role, then text; a
null turn comes first.  Rows with a null conv_id form one conversation.  An
empty table gives no segments.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, seq long, segment string, kind string, loss boolean, in_order boolean"
FLUSH_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Turn marks, which roles carry loss, and the roles that may follow each state."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_close: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: tuple[str, ...] = ("system", "user")
    follows: dict = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    # Control strings begin with "<|".  A text's "<", backslashes, "|" gets one more backslash.
    def escape(self, text: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\\\1|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<\\(\\*)\|", r"<\1|", text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def opening(self, role: str) -> str:
        return f"{self.start}{self.escape_role(role)}{self.after_role}"

    def closing(self) -> str:
        return self.close + self.after_close

    def allowed(self, state: str | None, role: str) -> bool:
        return role in (self.first if state is None else self.follows.get(state, ()))


DEFAULT = Template()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["conv_id", "seq", "segment", "kind", "loss", "in_order"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, seq = object(), None, 0
        rows, held = [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                role, text = role or "", text or ""
                if conv != current:
                    current, state, seq = conv, None, 0
                ok = template.allowed(state, role)
                state = role
                content = template.escape(text)
                for segment, kind, loss in (
                    (template.opening(role), "open", False),
                    (content, "text", role in template.loss_roles),
                    (template.closing(), "close", False),
                ):
                    rows.append((conv, seq, segment, kind, loss, ok))
                    seq += 1
                held += len(content)
                if held > FLUSH_CHARS or len(rows) > 20_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def format_chat(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of all conversations: conv_id, seq, segment, kind, loss, in_order.

    Partitions hold whole conversations with their segments in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template), SEGMENTS)


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, False
        turns, loss, n, lost, chars, ok = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for conv, segment, flag, good in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "in_order"))):
                if not live or conv != current:
                    if live:
                        out.append((current, n, turns.hexdigest(), lost, loss.hexdigest(), chars, ok))
                    current, live = conv, True
                    turns, loss, n, lost, chars, ok = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                chars += len(segment)
                ok = ok and good
                if flag:
                    plain = template.unescape(segment)
                    lost += len(plain)
                    loss.update(plain.encode())
                # What a segment is follows from its text alone.
                if segment.startswith(template.start) and segment.endswith(template.after_role):
                    role = template.unescape_role(segment[len(template.start) : len(segment) - len(template.after_role)])
                    turns.update(role.encode() + b"\n")
                elif segment == template.closing():
                    turns.update(b"\n")
                    n += 1
                else:
                    turns.update(template.unescape(segment).encode())
            if len(out) > 10_000:
                yield made()
                out.clear()
        if live:
            out.append((current, n, turns.hexdigest(), lost, loss.hexdigest(), chars, ok))
        if out:
            yield made()

    return run


def read_back(segments: DataFrame, template: Template = DEFAULT, in_place: bool = False) -> DataFrame:
    """Digests of every conversation, from its segments.

    ``in_place``: the segments lie as format_chat() left them; else they are
    brought together and put in order.
    """
    if not in_place:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"
    return segments.select("conv_id", "segment", "loss", "in_order").mapInArrow(_read(template), schema)
