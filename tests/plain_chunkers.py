"""The chunk rules one document, unit and row at a time, to compare results with."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from lodestone.functions.text import WHITESPACE

Chunk = tuple[str, str | None]
BREAKS = " \n\t"


def split_oversize(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end after a blank where there is one and restart ``overlap`` earlier."""
    out, start = [], 0
    while True:
        end = start + size
        if end < len(text):
            last_break = max(text.rfind(c, start, end) for c in BREAKS)
            end = last_break + 1 if last_break >= 0 else end
        piece = text[start:end].strip(WHITESPACE)
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        resume = max(end - overlap, 0)
        while resume < len(text) and text[resume] in BREAKS:
            resume += 1
        start = max(resume, start + 1)
        if start >= len(text):
            return out


def _fit(text: str, header: str | None, size: int, overlap: int) -> list[Chunk]:
    pieces = [text] if len(text) <= size else split_oversize(text, size, overlap)
    return [(p, header) for p in pieces]


def paragraph_chunks(texts: list[str], size: int, overlap: int) -> list[Chunk]:
    """Fill a chunk with whole paragraphs; the tail that covers ``overlap`` (at
    least one paragraph) opens the next chunk."""
    ends = [0, *accumulate(len(t) + 1 for t in texts)]
    cuts, start = [], 0
    for i in range(1, len(texts)):
        if ends[i + 1] - ends[start] > size:
            cuts.append((start, i))
            start = min(max(bisect_right(ends, ends[i] - overlap) - 1, start), i - 1)
    if texts:
        cuts.append((start, len(texts)))
    out: list[Chunk] = []
    for a, b in cuts:
        out += _fit("\n".join(texts[a:b]), None, size, overlap)
    return out


def section_chunks(texts: list[str], headers: list[str | None], size: int, overlap: int) -> list[Chunk]:
    """One chunk per unit, split only where the unit is too long."""
    return [c for t, h in zip(texts, headers) for c in _fit(t, h, size, overlap)]


def row_group_chunks(rows: list[tuple[str, str, str]], size: int) -> list[Chunk]:
    """Rows ``(sheet, header, line)`` packed below their sheet's header line.

    A full group is emitted when the next row would not fit; open groups are
    emitted at the end in the order the sheets first appeared.
    """
    out: list[Chunk] = []
    groups: dict[str, list[str]] = {}
    lengths: dict[str, int] = {}
    for sheet, header, line in rows:
        group = groups.setdefault(sheet, [header])
        lengths.setdefault(sheet, len(header) + 1)
        if not line:
            continue
        if len(group) > 1 and lengths[sheet] + len(line) + 1 > size:
            out.append(("\n".join(group).strip(WHITESPACE), None))
            del group[1:]
            lengths[sheet] = len(group[0]) + 1
        group.append(line)
        lengths[sheet] += len(line) + 1
    out += [("\n".join(g).strip(WHITESPACE), None) for g in groups.values()]
    return [c for c in out if c[0]]
