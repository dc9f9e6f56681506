"""Phrases of a text cut at rolling-hash triggers, so that equal passages are cut alike."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lodestone.llm.textbytes import SubstringHash, row_of

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 16  # bytes under the rolling hash
REACH = 64  # starts among which the smallest rolling hash is the trigger; REACH - 1 + GRAM <= LENGTH
CORE = LENGTH - REACH + 1  # bytes from a trigger on that lie in every string it stands for


class Phrases(NamedTuple):
    """Runs of starts whose 100-byte strings share a trigger."""

    row: np.ndarray
    start: np.ndarray  # in the row
    count: np.ndarray  # starts in the run
    core: np.ndarray  # hash of the CORE bytes from the trigger on
    context: np.ndarray  # hash of the bytes under all strings of the run


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    tiles = padded.reshape(-1, width)
    forward = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    backward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def phrases(raw: np.ndarray, offsets: np.ndarray, hashed: SubstringHash) -> Phrases:
    """The phrases of the rows of a block.

    A string of LENGTH bytes is represented by the trigger among its first REACH
    positions: the one whose GRAM bytes have the smallest rolling hash, the
    leftmost of equals.  The choice depends on the string alone, so equal strings
    have their trigger at the same place.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    rolling = hashed.windows(GRAM)
    keyed = (rolling & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rolling), dtype=np.uint64)
    trigger = (_sliding_least(keyed, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)[: len(raw) - LENGTH + 1]

    inside = np.ones(len(trigger), bool)  # starts whose string stays in its row
    for end in offsets[1:]:
        inside[max(end - LENGTH + 1, 0) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    trigger = trigger[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(trigger) != 0) | (np.diff(starts) != 1)
    first = starts[new]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    trigger = trigger[new]
    row = np.searchsorted(offsets, first, side="right") - 1
    return Phrases(
        row,
        first - offsets[row],
        count,
        hashed(trigger, trigger + CORE),
        hashed(first, first + count - 1 + LENGTH),
    )
