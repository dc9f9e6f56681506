"""Texts that have to be shuffled travel compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodestone.llm.textbytes import flat


def pack_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns, and the text's UTF-8 bytes compressed one by one as ``packed``; a null is empty."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, offsets = flat(batch.column(text))
            packed = [squeeze.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*others, "packed"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, text).mapInArrow(run, f"{kinds}, packed binary")


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each packed text."""
    opened = zstandard.ZstdDecompressor()
    for value in column:
        yield np.frombuffer(opened.decompress(value.as_buffer()), np.uint8)
