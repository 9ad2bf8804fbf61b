"""Quality rules by compression bands.

A text's *ratio* is its UTF-8 size over its zstandard size.  It is taken over
the whole document and over each fixed chunk of ``CHUNK`` bytes.  Repetitive
text compresses too well, random text too badly; what is usual depends on the
length, so the limits are a table by length.

Defined results
* null text is treated as empty.
* the ratio of an empty text is 1.  Texts of under 100 bytes have a band of their
  own: zstandard's frame alone makes them up to ten times larger, so only the high limit
  says anything of them.
* very long texts are compressed whole.
* ties: a ratio equal to a limit is within it.
* the last chunk is merged into the one before it where it would be shorter
  than half a chunk, so every text has at least one chunk.
* each row is judged alone: repeated rows get equal results, extra columns,
  whatever their names, have no influence, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEVEL = 3
CHUNK = 4096


class Band(NamedTuple):
    """Limits of texts of ``least`` bytes and more, up to the next band."""

    least: int
    low: float
    high: float
    chunk_low: float
    chunk_high: float


#: Limits by length, in ascending order.
BANDS = (
    Band(0, 0.05, 2.5, 0.05, 2.5),
    Band(100, 0.85, 3.0, 0.85, 3.0),
    Band(500, 1.2, 3.5, 1.2, 3.5),
    Band(2_000, 1.4, 4.0, 1.4, 5.0),
    Band(8_000, 1.5, 5.0, 1.4, 8.0),
    Band(50_000, 1.5, 6.0, 1.4, 8.0),
)
SCHEMA = "doc_id long, n_bytes long, ratio double, min_chunk_ratio double, max_chunk_ratio double, verdict string, keep boolean"


def chunk_bounds(n: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Byte ranges of the chunks of a text of n bytes."""
    k = max(1, n // chunk + (n % chunk >= chunk // 2 and n >= chunk))
    return [(i * chunk, n if i == k - 1 else (i + 1) * chunk) for i in range(k)]


def verdict(n: int, ratio: float, low: float, high: float, bands: tuple[Band, ...] = BANDS) -> str:
    """``ok``, ``repetitive`` or ``incompressible``, by the last band that begins at n bytes or below."""
    band = [b for b in bands if n >= b.least][-1]
    if ratio > band.high or high > band.chunk_high:
        return "repetitive"
    if ratio < band.low or low < band.chunk_low:
        return "incompressible"
    return "ok"


def measured(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """Size, ratios, verdict and whether it stays, of every document row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        size = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                n = len(raw)
                whole = n / len(size.compress(raw)) if n else 1.0
                bounds = chunk_bounds(n, chunk)
                parts = [whole] if len(bounds) == 1 else [(e - s) / len(size.compress(raw[s:e])) for s, e in bounds]
                out.append((n, whole, min(parts), max(parts), verdict(n, whole, min(parts), max(parts), bands)))
            if out:
                n, ratio, low, high, v = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ratio), pa.array(low), pa.array(high), pa.array(v), pa.array([x == "ok" for x in v])], ["doc_id", "n_bytes", "ratio", "min_chunk_ratio", "max_chunk_ratio", "verdict", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
