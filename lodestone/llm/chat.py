r"""Chat formatting: conversations assembled as bytes, column by column.

A turn becomes ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts a control
string gets a backslash after its first character (``<\/s>``), and one that already
has backslashes there gets one more; taking one away again restores every text.

Turns are sorted within their conversation by Spark.  For each Arrow batch the
lengths of all segments (headers, roles, texts, ends) give the cumulative offsets,
and numpy scatters the segments into one preallocated buffer that backs the Arrow
string column.  A conversation is written as one or more *parts*, runs of its turns
in one batch, so no conversation has to fit into memory; a part carries the
character ranges of the loss mask.

Turns are ordered by ``turn`` (null first), then role, then text; equal rows are all
kept.  A null text is an empty one, a null role an empty role; a null ``conv_id`` is
a conversation of its own.  A text of any length is one segment of a part.  No turns
give no conversations.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbytes import flat

# The template (fixed values).
OPEN, HEAD_END, END = "<s>[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"

PART_BYTES = 4 * 1024 * 1024
LONG_SEGMENT = 16 * 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return re.sub(_ESCAPED, r"\1\2\3", text)


def scatter(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of segments copied into one buffer.

    ``segments`` are byte columns (bytes, row offsets) of equal row count.  Gives
    the buffer, the offset of each row, and each segment's start in it
    (rows x segments).
    """
    lengths = np.stack([np.diff(offsets) for _, offsets in segments], axis=1)
    ends = np.cumsum(lengths.reshape(-1))
    starts = (ends - lengths.reshape(-1)).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (raw, offsets) in enumerate(segments):
        long = lengths[:, k] > LONG_SEGMENT  # copied whole: an index for each of its bytes would cost 16 times as much
        for row in np.flatnonzero(long):
            out[starts[row, k] : starts[row, k] + lengths[row, k]] = raw[offsets[row] : offsets[row + 1]]
        count = np.where(long, 0, lengths[:, k])
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[within + np.repeat(starts[:, k], count)] = raw[within + np.repeat(offsets[:-1], count)]
    rows = np.append(starts[:, 0], len(out)) if len(ends) else np.zeros(1, np.int64)
    return out, rows, starts


def _constant(value: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(value.encode(), np.uint8)
    return np.tile(raw, n), np.arange(n + 1) * len(raw)


def _characters(out: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    running = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=running[1:])
    return running


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss`` in conversation order inside each task.

    ``loss`` holds the character ranges (start, end) of the learned texts in
    ``formatted``.  Turns travel once, by ``conv_id``; a conversation of any size is
    streamed part by part.
    """
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escaped(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for whole in batches:
            sizes = np.diff(flat(whole.column("text"))[1])
            a = 0
            while a < whole.num_rows:
                taken = int(np.searchsorted(np.cumsum(sizes[a:]), PART_BYTES, side="right"))
                b = min(a + max(taken, 1), whole.num_rows)
                batch = whole.slice(a, b - a)
                a = b
                n = batch.num_rows
                out, rows, starts = scatter(
                    [
                        _constant(OPEN, n),
                        flat(batch.column("role")),
                        _constant(HEAD_END, n),
                        flat(batch.column("text")),
                        _constant(END, n),
                    ]
                )
                conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
                conv = np.where(batch.column("conv_id").is_null(), None, conv.astype(object))
                new = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
                bounds = np.append(rows[new], len(out))
                chars = _characters(out)
                learned = np.array(batch.column("role").to_pylist(), object) == LEARNED_ROLE
                owner = np.searchsorted(new, np.flatnonzero(learned), side="right") - 1
                base = chars[bounds[owner]]
                begin, end = chars[starts[learned, 3]] - base, chars[starts[learned, 4]] - base
                parts = []
                for k in new:
                    part = part + 1 if conv[k] == last and len(parts) == 0 else 0
                    last = conv[k]
                    parts.append(part)
                ranges = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "end"])
                counts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(new))))
                text = pa.StringArray.from_buffers(
                    len(new), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(conv[new].tolist(), pa.int64()),
                        pa.array(parts, pa.int64()),
                        pa.array(np.diff(np.append(new, n))),
                        text,
                        pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), ranges),
                    ],
                    ["conv_id", "part", "n_turns", "formatted", "loss"],
                )

    return ordered.mapInArrow(
        run, "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
    )


def parse_part(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the turns of one part, every escape undone."""
    turns = []
    for turn in formatted[: -len(END)].split(END) if formatted else []:
        role, _, text = turn[len(OPEN) :].partition(HEAD_END)
        turns.append((unescaped(role), unescaped(text)))
    return turns


def learned_texts(formatted: str, loss: list[dict]) -> list[str]:
    """The texts under the loss mask, every escape undone."""
    return [unescaped(formatted[r["start"] : r["end"]]) for r in loss]


def read_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, part, position, role, text`` of every turn, parsed back from the formatted parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, text = (batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted"))
            rows = [(c, p, k, *turn) for c, p, t in zip(conv, part, text) for k, turn in enumerate(parse_part(t))]
            columns = zip(*rows) if rows else ([],) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "position", "role", "text"]
            )

    return formatted.select("conv_id", "part", "formatted").mapInArrow(
        run, "conv_id long, part long, position long, role string, text string"
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted parts.

    Parts have to arrive as :func:`format_conversations` returns them; digests are
    carried from part to part, so only one part is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def close() -> None:
            if current:
                conv, n, turns, chars, learned, length = current
                done.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), length))

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done.clear()

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if current is None or current[0] != conv:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_part(text):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                for said in learned_texts(text, loss):
                    current[3] += len(said)
                    current[4].update(said.encode())
                current[5] += len(text)
            yield from flush()
        close()
        yield from flush()

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
