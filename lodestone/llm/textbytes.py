"""Arrow string columns as flat byte arrays: words, lines and substring hashes in numpy.

The per-byte helpers work on a *block*: the bytes of a run of rows end to end and
the offsets where each row starts.  Callers cut an Arrow batch into blocks of a
few MB, so the temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 * 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of about ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the SplitMix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base, grown on demand and kept by the worker."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_powers = Powers()


class SubstringHash:
    """64-bit hashes of substrings of one block, each in constant time.

    The sum of (byte + 1) * base**position is kept as a running total modulo
    2**64.  The base is odd, so dividing by its power moves a substring to
    position 0.  For short windows only: there are texts of 1,024 bytes that such a
    hash cannot tell apart, whatever the base; spans of any length have :func:`span_hashes`.
    """

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _powers.upto(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of every substring of that length."""
        n = len(self.total) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.total[length:] - self.total[:n]) * self.down[:n] + np.uint64(length))


_LONG_SPAN = 512


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)`` of one block.

    A span is read eight bytes at a time and mixed after each; different spans meet
    by chance only.  The few spans over ``_LONG_SPAN`` bytes are hashed one by one.
    """
    size = (end - start).astype(np.int64)
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).data, 0, (1,))
    out = mix(size.astype(np.uint64) + _BASE)
    within = size <= _LONG_SPAN
    for at in range(0, int(size[within].max(initial=0)), 8):
        left = np.flatnonzero(within & (size > at))
        part = eight[start[left] + at]
        rest = size[left] - at
        cut = rest < 8
        part[cut] &= (np.uint64(1) << (rest[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[left] = mix(out[left] * _BASE_INVERSE + part)
    for i in np.flatnonzero(~within):
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) and words before each row."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word also ends where its row does
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, order kept."""
    out = parts[0]
    for part in parts[1:]:
        out = mix(out * _BASE + part)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
