"""Stateless operators over streams: cleaning and encoding run unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..model import Model
from ..operators import clean, codec


def encode_stream(stream: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of a stream of ``(key, text)``."""
    return codec.encode(stream, model, key)


def clean_stream(stream: DataFrame, key: str = "doc_id", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Cleaned lines with their status; with a watermark ``(column, delay)`` repeats within it are dropped."""
    rows = clean.lines(stream, key) if watermark is None else stream.select(key, watermark[0], F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("line_no", "line"))
    out = rows.withColumn("clean", clean.clean(F.col("line"))).drop("line")
    if watermark is not None:
        out = out.withWatermark(*watermark).dropDuplicatesWithinWatermark(["clean"])
    return out


def normalize_stream(stream: DataFrame, flags: T.Norm = T.Norm.WHITESPACE) -> DataFrame:
    return stream.withColumn("text", T.normalize(F.col("text"), flags))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over what is there and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
