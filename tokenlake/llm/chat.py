"""Chat formatting with a grammar round trip (operator 2).

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Each rendering is read again by a
deterministic parser; if the turns that come back differ from the source, the conflicting content is
escaped and the rendering tried again until they are identical. The escape puts a backslash into
every ``<|`` of the content (``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|``), so an escaped text holds no
control string, and the parser takes one backslash out again. A line break in a role becomes the
control string ``<|nl|>``. Every turn starts and ends with its own control strings, so turns that
survive the round trip one by one also survive it joined.

Rendering is done turn by turn before any shuffle. Joining a conversation's turns streams over
sorted rows and cuts the output every ``CHUNK_CHARS`` characters, so a conversation of any length needs
bounded memory.

Defined results: null role or text counts as empty; a null conv_id is a conversation of its own; ties
in ``turn`` go by role, then text; repeated rows are turns of their own; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
CHUNK_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


class GrammarError(ValueError):
    """The text is no sequence of turns."""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string; raises GrammarError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line)
        if line < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise GrammarError(f"the turn at {at} does not end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in text or "<|" in role.replace(LINE, ""):
            raise GrammarError(f"control string inside the turn at {at}")
        turns.append((unescape(role.replace(LINE, "\n")), unescape(text)))
        at = end + len(END) + 1
    return turns


def round_trip(role: str, text: str) -> tuple[str, str]:
    """(role, text) as they must be written so that the parser gives back the source."""
    safe_role = escape(role).replace("\n", LINE)
    for r, t in ((role, text), (role, escape(text)), (safe_role, text), (safe_role, escape(text))):
        try:
            if parse(render(r, t)) == [(role, text)]:
                return r, t
        except GrammarError:
            pass
    raise AssertionError("an escaped turn must come back")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [round_trip(r or "", t or "") for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["turn"], batch["role"], batch["text"],
             pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())],
            ["conv_id", "turn", "role", "text", "safe_role", "safe_text"],
        )


_PARTS = "conv_id long, part long, formatted string, n_turns long, loss_start array<int>, loss_end array<int>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a conversation, in order, joined into parts; the loss spans are the assistant's texts."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()),
                        ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])
    conv, part, size, pieces, starts, ends, begun = None, 0, 0, [], [], [], False
    out: list[tuple] = []

    def cut() -> None:
        out.append((conv, part, "".join(pieces), len(pieces), list(starts), list(ends)))
        pieces.clear(), starts.clear(), ends.clear()

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
        out.clear()
        return made

    for batch in batches:
        held = 0
        for c, role, r, t in zip(*(batch[k].to_pylist() for k in ("conv_id", "role", "safe_role", "safe_text")), strict=True):
            if begun and (c != conv or size >= CHUNK_CHARS):
                cut()
                held += size
                part, size = (0 if c != conv else part + 1), 0
                if held >= 8 * CHUNK_CHARS:
                    yield batch_of()
                    held = 0
            conv, begun = c, True
            piece = render(r, t)
            if role == "assistant":
                first = size + len(START) + len(r) + 1
                starts.append(first)
                ends.append(first + len(t))
            pieces.append(piece)
            size += len(piece)
        if out:
            yield batch_of()
    if begun:
        cut()
        yield batch_of()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, n_turns, loss_start, loss_end): the parts of a conversation in order.

    Loss spans are code-point offsets in the part; they hold the escaped text of each assistant turn.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rendered = turns.mapInArrow(_rendered, "conv_id long, turn long, role string, text string, safe_role string, safe_text string")
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "safe_role", "safe_text").mapInArrow(_joined, _PARTS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state: list = []
    out: list[dict] = []

    def close() -> None:
        if state:
            c, n, turns, chars, loss, size = state
            out.append(dict(zip(schema.names, (c, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True)))

    for batch in batches:
        columns = (batch[k].to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end"))
        for c, formatted, starts, ends in zip(*columns, strict=True):
            if not state or state[0] != c:
                close()
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(formatted)
            for role, text in turns:
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                text = unescape(formatted[a:b])
                state[3] += len(text)
                state[4].update(text.encode())
            state[1] += len(turns)
            state[5] += len(formatted)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted parts hold, read with the parser: one row per conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read_back, _DIGESTS)
