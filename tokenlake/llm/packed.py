"""Columnar blocks between tasks: numpy arrays packed into binary rows and sent to numbered partitions.

An exchange of small fixed-size records costs the JVM a row each; here a map
task packs the records for one partition into one binary value, so that a
shuffle moves few large rows and the receiving task works on whole arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that are worked on at once; there are some ten arrays of 8 times as much.
SLICE_BYTES = 1 << 20
#: Stands for a null doc_id inside packed records.
NULL_ID = -(1 << 63)
SCHEMA = "part int, data binary"
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of input, as Spark estimates it from the files, to a partition of an exchange.
INPUT_BYTES = 256 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """The session's number of shuffle partitions, or more where ``df`` is too large for so few."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if df is not None else 0
    return max(n, -(-size // INPUT_BYTES)) if size < 1 << 60 else n  # beyond: not known


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        texts = batch.column(column)
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        at = 0
        total = np.cumsum(size)
        while at < len(texts):
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, as Spark keeps a Python worker for later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_id(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """``(doc_id, key)`` by which packed records name a document row: ``NULL_ID`` for null, and a hash of the text whose last bit tells that."""
    key = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(1))
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)), key.bitwiseAND(F.lit(-2)).bitwiseOR(F.when(doc_id.cast("long").isNull(), 1).otherwise(0))


def identity(docs: DataFrame, *extra: str) -> DataFrame:
    """``(doc_id, key, text, ...)``; rows equal in doc_id and text are one document."""
    doc, key = row_id(F.col("doc_id"), F.col("text"))
    return docs.select(doc.alias("doc_id"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in extra])


def null_back(doc_id: str = "doc_id", key: str = "key") -> Column:
    """The doc_id as in the input."""
    return F.when((F.col(doc_id) == F.lit(NULL_ID)) & (F.col(key).bitwiseAND(F.lit(1)) == 1), F.lit(None)).otherwise(F.col(doc_id)).alias("doc_id")


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Partition number of each 64-bit hash."""
    return ((((h * MULTIPLY) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pack(records: np.ndarray, part: np.ndarray, n: int) -> pa.RecordBatch | None:
    """One row per partition with its structured records, stored field after field."""
    if not len(records):
        return None
    order = np.argsort(part.astype(np.int32), kind="stable")
    records, part = records[order], part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[at[1:], len(part)]
    data = [b"".join(np.ascontiguousarray(records[name][a:b]).tobytes() for name in records.dtype.names) for a, b in zip(at, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])


def unpack(blocks: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of the blocks that came to this partition."""
    parts = []
    for batch in blocks:
        for value in batch.column(1):
            raw = value.as_buffer()
            n = raw.size // dtype.itemsize
            out = np.empty(n, dtype)
            at = 0
            for name in dtype.names:
                kind = dtype[name]
                out[name] = np.frombuffer(raw, kind, n, at)
                at += n * kind.itemsize
            parts.append(out)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def exchange(df: DataFrame, make: Callable, reduce: Callable, schema: str, n: int | None = None) -> DataFrame:
    """``make`` packs the rows of ``df``, ``reduce`` gets the blocks of one partition."""
    n = n or partitions(df.sparkSession, df)
    return df.mapInArrow(make, SCHEMA).repartitionById(n, F.col("part")).mapInArrow(reduce, schema)
