"""Chat formatting by columnar byte assembly (operator 1).

Every turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  A task lays out a
whole Arrow batch at once: it computes the lengths of all segments (fixed
marks, roles, texts), their offsets by a cumulative sum, and scatters headers
and contents into one preallocated buffer that becomes the Arrow column.

Control strings (``CONTROLS``) inside roles and texts are made harmless
reversibly: a backslash is put behind their first character.  A text that
already holds the escaped form gets one backslash more, so taking one away
restores every text exactly, and ordinary text is left as it is.

Rows of a conversation are ordered by turn (ties: role, text).  A conversation
is given out in parts of at most one Arrow batch, in order, so one with very
many turns needs no more memory; readers go through the parts in order and
keep running digests.

Defined cases: null role or text counts as empty; rows with a null conv_id
form one conversation; repeated rows are kept; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, partitions
from .textblock import binary_column, gather_ranges, text_arrays

START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = [START, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
LOSS_ROLE = "assistant"

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE = rf"([<\[])(\\*(?:{_REST}))"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*(?:{_REST}))")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)

PARTS = "conv_id long, part long, n_turns long, formatted string, loss_start array<int>, loss_length array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=ESCAPE, replacement=r"\1\\\2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _escape_role(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return escape(column)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets])


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted strings of groups of turns (``first``: first turn of each, n + 1); start and length in code points of every turn's text."""
    role_data, role_at = text_arrays(_escape_role(roles))
    text_data, text_at = text_arrays(escape(texts))
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    n = len(role_at) - 1
    # Segments of a turn, in order: mark, role, newline, text, end mark.
    lengths = np.empty((n, 5), np.int64)
    for column, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        lengths[:, column] = len(part)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for column, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(starts[:, column, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    out[gather_ranges(starts[:, 1], lengths[:, 1])] = role_data[role_at[0] : role_at[-1]]
    out[gather_ranges(starts[:, 3], lengths[:, 3])] = text_data[text_at[0] : text_at[-1]]
    turn_at = np.concatenate((starts[:, 0], [len(out)]))
    formatted = binary_column(out, turn_at[first]).cast(pa.string())
    role_chars, text_chars = _characters(role_data, role_at), _characters(text_data, text_at)
    turn_chars = role_chars + text_chars + sum(map(len, fixed))
    before = np.concatenate(([0], np.cumsum(turn_chars)))
    base = np.repeat(before[first[:-1]], np.diff(first))
    return formatted, before[:-1] - base + len(START) + role_chars + 1, text_chars


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        ids = conv.to_numpy(zero_copy_only=False) if not conv.null_count else np.array(conv.to_pylist(), object)
        change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        first = np.concatenate(([0], change, [len(ids)]))
        formatted, start, length = assemble(pc.fill_null(batch.column(1), ""), pc.fill_null(batch.column(2), ""), first)
        mask = pc.fill_null(pc.equal(batch.column(1), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(mask)))[first]
        heads = conv.take(pa.array(first[:-1]))
        parts = np.zeros(len(first) - 1, np.int64)
        parts[0] = part + 1 if heads[0].as_py() == last else 0
        last, part = heads[-1].as_py(), int(parts[-1])
        yield pa.RecordBatch.from_arrays(
            [heads, pa.array(parts), pa.array(np.diff(first)), formatted, *(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x[mask], pa.int32())) for x in (start, length))],
            ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_length"],
        )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations: (conv_id, part, n_turns, formatted, loss_start, loss_length).

    Loss spans are in code points of ``formatted``.  Rows of one conversation
    lie in one partition, parts in order.
    """
    rows = turns.select("conv_id", "role", "text", "turn")
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").transform(map_arrow, _format_partition, PARTS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted string."""
    return [(_unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, rows = None, None, []

    def close() -> None:
        if state is not None:
            rows.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)
        rows.clear()
        return out

    for batch in batches:
        for conv, part, formatted, starts, lengths in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if part == 0 or state is None:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for s, n in zip(starts, lengths):
                text = unescape(formatted[s : s + n])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield flush()
    close()
    yield flush()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, from the strings and loss spans alone."""
    return parts.transform(map_arrow, _read_partition, DIGESTS)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts are control strings."""
    probe = turns.sparkSession.sql(
        "SELECT -7L AS conv_id, pos AS turn, role, '</s>[INST] ok [/INST]' AS text FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))"
    )
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
