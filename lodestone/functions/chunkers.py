"""Chunk rules with carry-over, for all documents of an Arrow batch in step.

Where a chunk ends and where the next one starts follows from running lengths and
from the places of blanks, by binary search.  So one round of array operations moves
every open document (unit, sheet) of the batch to its next chunk, and there are as
many rounds as the longest of them has chunks.  Texts are only cut once the places
are known.  Sizes count code points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from lodestone.functions.text import WHITESPACE

BREAKS = [ord(c) for c in " \n\t"]
BLOCK_CHARS = 2_000_000  # of units that are cut at once; bounds memory only

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]  # owner, first, end


def _sorted_by_owner(rounds: list[Spans]) -> Spans:
    if not rounds:
        none = np.zeros(0, np.int64)
        return none, none, none
    owner, first, end = (np.concatenate(part) for part in zip(*rounds))
    order = np.argsort(owner, kind="stable")  # rounds are in the order of the chunks
    return owner[order], first[order], end[order]


def windows(points: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, overlap: int) -> Spans:
    """Windows of the units ``[start, end)`` of a text.

    A window ends behind its last blank, if it has one; the next starts ``overlap``
    earlier, past blanks, and always moves on.
    """
    blank = np.isin(points, BREAKS)
    blanks = np.flatnonzero(blank)
    edges = np.diff(np.concatenate([[False], blank, [False]]).astype(np.int8))
    run_start, run_end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    unit, at = np.arange(len(start)), start.copy()
    rounds: list[Spans] = []
    while len(unit):
        limit = end[unit]
        stop = np.minimum(at + size, limit)
        if len(blanks):
            last = np.searchsorted(blanks, stop) - 1
            found = blanks[np.maximum(last, 0)]
            stop = np.where((stop < limit) & (last >= 0) & (found >= at), found + 1, stop)
        rounds.append((unit, at, stop))
        resume = np.maximum(stop - overlap, start[unit])
        if len(run_start):
            run = np.maximum(np.searchsorted(run_start, resume, side="right") - 1, 0)
            inside = (run_start[run] <= resume) & (resume < run_end[run])
            resume = np.where(inside, np.minimum(run_end[run], limit), resume)
        following = np.maximum(resume, at + 1)
        goes_on = (stop < limit) & (following < limit)
        unit, at = unit[goes_on], following[goes_on]
    return _sorted_by_owner(rounds)


def packed_paragraphs(lengths: np.ndarray, first: np.ndarray, size: int, overlap: int) -> Spans:
    """Runs of whole paragraphs of the documents that begin at ``first`` (one entry more than documents).

    A run is filled up to ``size``; the tail that covers ``overlap``, at least one
    paragraph, opens the next.
    """
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    doc = np.flatnonzero(np.diff(first) > 0)
    at, least = first[doc], first[doc] + 1
    rounds: list[Spans] = []
    while len(doc):
        limit = first[doc + 1]
        cut = np.maximum(np.searchsorted(ends, ends[at] + size, side="right") - 1, least)
        cut = np.minimum(cut, limit)
        rounds.append((doc, at, cut))
        tail = np.searchsorted(ends, ends[cut] - overlap, side="right") - 1
        goes_on = cut < limit
        doc, at, least = doc[goes_on], np.minimum(np.maximum(tail, at), cut - 1)[goes_on], (cut + 1)[goes_on]
    return _sorted_by_owner(rounds)


def packed_rows(lengths: np.ndarray, first: np.ndarray, heads: np.ndarray, size: int) -> Spans:
    """Runs of rows of the sheets that begin at ``first``, each below a head line of ``heads`` characters."""
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    sheet = np.flatnonzero(np.diff(first) > 0)
    at = first[sheet]
    rounds: list[Spans] = []
    while len(sheet):
        room = size - heads[sheet] - 1
        cut = np.searchsorted(ends, ends[at] + room, side="right") - 1
        cut = np.minimum(np.maximum(cut, at + 1), first[sheet + 1])
        rounds.append((sheet, at, cut))
        goes_on = cut < first[sheet + 1]
        sheet, at = sheet[goes_on], cut[goes_on]
    return _sorted_by_owner(rounds)


def split_texts(texts: Sequence[str], size: int, overlap: int) -> tuple[list[str], np.ndarray]:
    """The pieces of every text, and how many each has; a text that fits is its own piece."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pieces: dict[int, list[str]] = {}
    long = np.flatnonzero(lengths > size)
    blocks = np.cumsum(lengths[long]) // BLOCK_CHARS
    for block in np.unique(blocks):
        units = long[blocks == block]
        end = np.cumsum(lengths[units])
        start = end - lengths[units]
        points = np.frombuffer("".join(texts[u] for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner, a, b = windows(points, start, end, size, overlap)
        for u, s, e in zip(units[owner].tolist(), (a - start[owner]).tolist(), (b - start[owner]).tolist()):
            piece = texts[u][s:e].strip(WHITESPACE)
            if piece:
                pieces.setdefault(u, []).append(piece)
    out, counts = [], np.ones(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = pieces.get(i, []) if lengths[i] > size else [text]
        counts[i] = len(own)
        out += own
    return out, counts


def paragraph_chunks(texts: Sequence[str], first: np.ndarray, size: int, overlap: int) -> tuple[list[str], np.ndarray]:
    """Chunks of the documents whose paragraphs begin at ``first``, and the number of chunks of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    doc, a, b = packed_paragraphs(lengths, first, size, overlap)
    packs = ["\n".join(texts[i:j]) for i, j in zip(a.tolist(), b.tolist())]
    pieces, counts = split_texts(packs, size, overlap)
    return pieces, np.bincount(doc, weights=counts, minlength=len(first) - 1).astype(np.int64)


def row_chunks(
    lines: Sequence[str], sheets: Sequence[str], heads: Sequence[str], first: np.ndarray, size: int
) -> tuple[list[str], np.ndarray]:
    """Rows packed below their sheet's head line, for the documents whose rows begin at ``first``.

    A full group comes where the next row of its sheet did not fit; open groups come
    at the end, in the order in which sheets first appeared.  A sheet of empty rows
    is its head line.
    """
    n = len(lines)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    number: dict[tuple[int, str], int] = {}
    sheet = np.array([number.setdefault(key, len(number)) for key in zip(owner.tolist(), sheets)], np.int64)
    if not n:
        return [], np.zeros(len(first) - 1, np.int64)
    _, opening = np.unique(sheet, return_index=True)  # a sheet's first row has its head
    head = [heads[i] for i in opening]
    filled = np.array([bool(t) for t in lines])
    order = np.argsort(sheet, kind="stable")
    order = order[filled[order]]
    begins = np.searchsorted(sheet[order], np.arange(len(number) + 1))
    lengths = np.array([len(lines[i]) for i in order], np.int64)
    group, a, b = packed_rows(lengths, begins, np.array([len(h) for h in head], np.int64), size)
    empty = np.flatnonzero(np.diff(begins) == 0)
    group, a, b = (np.concatenate(p) for p in ((group, empty), (a, begins[empty]), (b, begins[empty])))
    open_ = b == begins[group + 1]
    place = np.where(open_, n + group, order[np.minimum(b, len(order) - 1)] if len(order) else 0)
    document = owner[opening][group]
    out, counts = [], np.zeros(len(first) - 1, np.int64)
    for k in np.lexsort((place, document)):
        text = "\n".join([head[group[k]], *[lines[i] for i in order[a[k] : b[k]]]]).strip(WHITESPACE)
        if text:
            out.append(text)
            counts[document[k]] += 1
    return out, counts
